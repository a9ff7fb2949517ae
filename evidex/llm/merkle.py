"""Merkle dataset manifest: authentication paths by fractal traversal of aligned blocks, upper proofs by joins.

A row's leaf is the digest of its fields. The leaves of a group (a language)
are numbered in the order of their ids; every 8 consecutive nodes become one
until one is left, the group's subroot, and the subroots of the groups, in
order, become the root in the same way.

Leaves are dealt by ranges of (group, id), so a group that holds a third of all
rows fills many tasks. Levels are built by grouping runs of 8 digests. Above
blocks of 4 096 leaves (four levels) a path is joined level by level from the
root down, one row for a block. Inside a block the paths come from a fractal
traversal: the block's height is cut into subtrees of two levels; for each
stacked level one subtree exists, which holds the current path's nodes, and one
is desired, the next one at its place, which takes in a leaf for every path
that is emitted and so is whole when the existing one is used up. A task holds
the digests of one block and those subtrees.

Defined cases: any field may be null and then is ``-``; groups come in the
order of their names, null first; rows of one id are ordered by their leaves,
null ids first; a group of one leaf has that leaf as its subroot; an only group
has its subroot as the root; an empty table has no rows; a row without an id is
never tampered with; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .scratch import Scratch
from .text import lower_ascii

#: Nodes that become one.
RUN = 8
#: Levels of a subtree of the traversal, and levels of a block.
SUBTREE, HEIGHT = 2, 4
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as its byte count and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Subtree:
    """The runs of ``levels`` levels over a run of leaves, filled leaf by leaf; of the ``base`` levels below only what is open."""

    def __init__(self, base: int, levels: int):
        self.base = base
        self.open = [""] * (base + levels)
        self.runs: list[list[str]] = [[] for _ in range(levels)]

    def _done(self, level: int, run: str) -> str:
        if level >= self.base:
            self.runs[level - self.base].append(run)
        self.open[level] = ""
        return _h(run)

    def add(self, digest: str) -> None:
        for level in range(len(self.open)):
            self.open[level] += digest
            if len(self.open[level]) < RUN * HEX:
                return
            digest = self._done(level, self.open[level])

    def close(self) -> None:
        """No more leaves: what is open becomes nodes as it is."""
        digest = ""
        for level in range(len(self.open)):
            run = self.open[level] + digest
            digest = self._done(level, run) if run else ""


def traverse(leaves: list[str], height: int) -> Iterator[list[tuple[int, str]]]:
    """For each leaf in turn, (place in its run, digests of the run) for each of ``height`` levels.

    ``leaves`` is read by one cursor for each stacked subtree; of the tree only
    the existing and the desired subtrees are held.
    """
    cuts = [(low, min(SUBTREE, height - low)) for low in range(0, height, SUBTREE)]
    spans = [RUN ** (low + levels) for low, levels in cuts]
    existing, desired = [Subtree(*cut) for cut in cuts], [Subtree(*cut) for cut in cuts]
    for tree, span in zip(existing, spans):
        for leaf in leaves[:span]:
            tree.add(leaf)
        tree.close()
    for n in range(len(leaves)):
        path = []
        for i, ((low, levels), span) in enumerate(zip(cuts, spans)):
            if n and n % span == 0:
                desired[i].close()
                existing[i], desired[i] = desired[i], Subtree(low, levels)
            for k in range(levels):
                path.append((n // RUN ** (low + k) % RUN, existing[i].runs[k][n % span // RUN ** (low + k + 1)]))
            # One leaf for the desired subtree: it is whole when the existing one is used up.
            if n + span < len(leaves):
                desired[i].add(leaves[n + span])
        yield path


def levels_of(n: Column, most: int) -> Column:
    """How often runs become nodes until one of ``n`` nodes is left, ``most`` at most."""
    return sum(((n > RUN**k).cast("int") for k in range(most)), F.lit(0))


def _run(*more: Column) -> list[Column]:
    """Aggregates of the digests of a run, in order."""
    return [F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("run"), *more]


def _up(nodes: DataFrame, level: int) -> DataFrame:
    """The next level of ``nodes`` (group, idx, height, digest); those of groups that are no higher than ``level`` stay."""
    above = F.col("height") > level
    rows = nodes.groupBy("group", "height", F.when(above, F.floor(F.col("idx") / RUN)).otherwise(F.col("idx")).cast("long").alias("up")).agg(*_run())
    return rows.select("group", F.col("up").alias("idx"), "height", F.when(above, _over(F.col("run"))).otherwise(F.get("run", F.lit(0))).alias("digest"))


def runs_of(nodes: DataFrame) -> DataFrame:
    """(group, idx, run): the digests of every ``RUN`` consecutive ``nodes`` (group, idx, digest), in order."""
    return nodes.groupBy("group", F.floor(F.col("idx") / RUN).cast("long").alias("up")).agg(*_run()).select("group", F.col("up").alias("idx"), "run")


def _over(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, idx, places, proof, top) of ``nodes`` (group, idx, digest): the path to the one node left in each group.

    ``proof`` has the digests of the others of each run, joined; ``places`` the node's own place in it.
    """
    nodes, built = scratch.write(nodes.select("group", "idx", "digest"), "nodes"), []
    while True:
        many = nodes.groupBy("group").agg(F.max("idx").alias("last")).where("last > 0").select("group")
        if many.isEmpty():
            break
        runs = scratch.write(runs_of(nodes.join(many, "group", "left_semi")), "runs")
        built.append(runs)
        done = nodes.join(many, "group", "left_anti")
        nodes = scratch.write(done.unionByName(runs.select("group", "idx", _over(F.col("run")).alias("digest"))), "nodes")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    known = nodes.select("group", "idx", empty("int").alias("places"), empty("string").alias("proof"), F.col("digest").alias("top"))
    for runs in reversed(built):
        up = known.join(runs, ["group", "idx"]).select("*", F.posexplode("run").alias("place", "digest"))
        # Without the digest at its place: the text before it and after it.
        joined, at = F.array_join("run", ""), F.col("place") * HEX
        others = F.concat(F.substring(joined, F.lit(1), at), F.substring(joined, at + HEX + 1, F.lit(RUN * HEX)))
        below = up.select(
            "group", (F.col("idx") * RUN + F.col("place")).alias("idx"), F.concat(F.array("place"), "places").alias("places"),
            F.concat(F.array(others), "proof").alias("proof"), "top",
        )
        # A group that was one node at this level has no run here; its path is as it was.
        alone = known.join(runs.select("group").distinct(), "group", "left_anti")
        known = scratch.write(below.unionByName(alone), "paths")
    return known


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order, the block's own row first, become rows with whole paths."""
    schema = pa.schema([("group", pa.string()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("changed", pa.string()),
                        ("places", pa.list_(pa.int32())), ("proof", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

    def whole_block(head: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, path in zip(rows, traverse([r[2] for r in rows], head["height"])):
            places = [p for p, _ in path] + head["places"]
            proof = [run[: p * HEX] + run[(p + 1) * HEX :] for p, run in path] + head["proof"]
            out.append((head["group"], row[0], row[1], row[2], row[3], places, proof, head["subroot"], head["root"]))
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    head, rows = None, []
    for batch in batches:
        plain = zip(*(batch.column(c).to_pylist() for c in ("idx", "doc_id", "leaf", "changed")))
        for i, row in enumerate(plain):
            if row[0] < 0:
                if head:
                    yield from whole_block(head, rows)
                head, rows = batch.slice(i, 1).to_pylist()[0], []
            else:
                rows.append(row)
    if head:
        yield from whole_block(head, rows)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(group, idx, doc_id, leaf, changed, places, proof, subroot, root) for each row of ``docs``.

    ``proof`` and ``places`` lead from the leaf over its subroot to the root, see
    ``folded``. ``changed`` is a leaf over the columns of ``docs`` to hold against them.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    own = leaf_digest(*map(F.col, FIELDS))
    # The group is wrapped, so that null is a group like any other wherever rows meet.
    group = F.struct(F.col("lang").cast("string").alias("lang")).alias("group")
    rows = docs.select(group, F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"), (own if changed is None else changed).alias("changed"))
    leaves = numbered(rows, ["doc_id", "leaf"], ["group"], "idx", "size", scratch.write)
    leaves = scratch.write(leaves.withColumn("height", levels_of(F.col("size"), HEIGHT)).drop("size"), "leaves")
    nodes = leaves.select("group", "idx", "height", F.col("leaf").alias("digest"))
    for level in range(HEIGHT):
        nodes = scratch.write(_up(nodes, level), f"level{level}")
    blocks = scratch.write(paths(nodes.select("group", "idx", "digest"), scratch).join(nodes.select("group", "idx", "height"), ["group", "idx"]), "blocks")
    tops = blocks.where("idx = 0").select("group", F.col("top").alias("digest"))
    ranked = scratch.write(numbered(tops, ["group"], name="idx", write=scratch.write), "ranked")
    above = paths(ranked.select(F.lit(0).alias("group"), "idx", "digest"), scratch)
    roots = ranked.join(above.select("idx", F.col("places").alias("places2"), F.col("proof").alias("proof2"), F.col("top").alias("root")), "idx")
    heads = blocks.join(roots.select("group", "places2", "proof2", "root"), "group").select(
        "group", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "height",
        F.concat("places", "places2").alias("places"), F.concat("proof", "proof2").alias("proof"), F.col("top").alias("subroot"), "root",
    )
    asked = leaves.drop("height").withColumn("block", F.floor(F.col("idx") / RUN**HEIGHT).cast("long")).unionByName(heads, allowMissingColumns=True)
    dealt = asked.repartition("group", "block").sortWithinPartitions("group", "block", "idx").withColumn("group", F.col("group.lang"))
    return dealt.mapInArrow(_emitted, "group string, idx long, doc_id long, leaf string, changed string, places array<int>, proof array<string>, subroot string, root string")


def folded(leaf: Column, places: Column, proof: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda own, x: F.sha2(
        F.concat(F.substring(x["proof"], F.lit(1), x["places"] * HEX), own, F.substring(x["proof"], x["places"] * HEX + 1, F.lit(RUN * HEX))), 256
    )
    return F.aggregate(F.arrays_zip(places.alias("places"), proof.alias("proof")), leaf, step)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(proof, ""), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text is lower-cased where 3 divides the CRC of its id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.col("text").cast("string")
    return leaf_digest(*map(F.col, FIELDS[:4]), F.when(hit, lower_ascii(text)).otherwise(text))
