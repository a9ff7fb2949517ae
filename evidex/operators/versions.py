"""Tables and exports in versions: what is written counts when its commit is, and readers see whole versions only.

A commit is one small file that names the folders of a version. It is written
last, under another name first, so a run that is killed leaves the version
before as it was; what it wrote is in no commit and is never read. One writer
at a time; any number of readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import names_in, no_path, read_file, write_file


class Commits:
    """The commits of a folder, numbered from 1."""

    def __init__(self, folder: str):
        self.folder = f"{folder.rstrip('/')}/commits"

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names_in(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def get(self, number: int) -> dict | None:
        """What a commit says, None if it can't be read."""
        try:
            return json.loads(read_file(f"{self.folder}/{number:012d}.json") or b"null")
        except ValueError:
            return None

    def last(self, most: int | None = None) -> tuple[int, dict] | None:
        """The latest commit that can be read, of those up to ``most``."""
        for number in reversed(self.numbers()):
            if most is None or number <= most:
                said = self.get(number)
                if said is not None:
                    return number, said
        return None

    def add(self, said: dict) -> int:
        number = (self.numbers() or [0])[-1] + 1
        write_file(f"{self.folder}/{number:012d}.json", json.dumps(said).encode())
        return number


class VersionedTable:
    """A keyed table as a base and deltas: a change writes its rows alone, reading merges, compaction writes a new base.

    A delta's row replaces the row of its key as a whole; a deleted key is a
    row that says so. Of several rows of one key in one delta the greatest
    stays. Rows without a key are told apart by nothing and count as one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.commits = Commits(folder)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def _part(self, path: str, place: int) -> DataFrame:
        kept = self.spark.createDataFrame([], self.schema).withColumn("_deleted", F.lit(False)).schema
        return self.spark.read.schema(kept).parquet(f"{self.folder}/{path}").withColumn("_place", F.lit(place))

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.columns, "_deleted").write.parquet(f"{self.folder}/{name}")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest by default."""
        found = self.commits.last(version)
        if not found or not found[1]["parts"]:
            return self.spark.createDataFrame([], self.schema)
        parts = [self._part(p, n) for n, p in enumerate(found[1]["parts"])]
        rows = parts[0]
        if len(parts) == 1:
            return rows.where("not _deleted").select(*self.columns)
        deltas = parts[1]
        for part in parts[2:]:
            deltas = deltas.unionByName(part)
        # The base is not grouped: what no delta names passes as it is.
        whole = F.struct("_place", "_deleted", *self.columns)
        last = deltas.groupBy(self.key).agg(F.max(whole).alias("_row"))
        here = F.col("_row._deleted").alias("_gone")
        named = last.select(F.struct(self.key).alias("_k"), here)
        untouched = rows.where("not _deleted").withColumn("_k", F.struct(self.key)).join(named, "_k", "left_anti").select(*self.columns)
        return untouched.unionByName(last.select("_row.*").where("not _deleted").select(*self.columns))

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace; columns that ``rows`` lacks are null."""
        given = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema), F.lit(False).alias("_deleted"))
        one = given.groupBy(self.key).agg(F.max(F.struct(*given.columns)).alias("_row")).select("_row.*")
        return self._commit(one)

    def delete(self, keys: DataFrame) -> int:
        gone = keys.select(F.col(self.key).cast(self.schema[self.key].dataType)).distinct()
        rows = gone.select(*(F.col(self.key) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema), F.lit(True).alias("_deleted"))
        return self._commit(rows)

    def _commit(self, delta: DataFrame) -> int:
        before = self.commits.last()
        name = self._write(delta)
        return self.commits.add({"parts": [*(before[1]["parts"] if before else []), name]})

    def compact(self) -> int:
        """One base of all; earlier versions can still be read."""
        name = self._write(self.read().withColumn("_deleted", F.lit(False)))
        return self.commits.add({"parts": [name]})


class Snapshot:
    """Exported documents by name; a version is what one export wrote, and reading falls back to the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.commits = spark, folder.rstrip("/"), Commits(folder)

    def write(self, documents: dict[str, DataFrame], carry: tuple[str, ...] = ()) -> dict[str, int]:
        """Rows of each document written. What ``carry`` names and this export lacks or has empty stays as the last version has it."""
        version, sizes, paths = f"v-{uuid.uuid4().hex}", {}, {}
        before = self.commits.last()
        for name, frame in documents.items():
            path = f"{version}/{name}"
            frame.write.json(f"{self.folder}/{path}", ignoreNullFields=False)
            sizes[name] = self.spark.read.text(f"{self.folder}/{path}").count()
            paths[name] = {"path": path, "schema": frame.schema.json()}
        for name in carry:
            if not sizes.get(name) and before and name in before[1]["documents"]:
                paths[name] = before[1]["documents"][name]
        self.commits.add({"documents": paths})
        return sizes

    def read(self, name: str, most: int | None = None) -> DataFrame | None:
        """A document of the latest version that has it and can be read, None if none has."""
        from pyspark.sql.types import StructType

        for number in reversed(self.commits.numbers()):
            said = (most is None or number <= most) and self.commits.get(number)
            if said and name in said["documents"]:
                entry = said["documents"][name]
                try:
                    return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).json(f"{self.folder}/{entry['path']}")
                except Exception as error:
                    if not no_path(error):
                        raise
        return None
