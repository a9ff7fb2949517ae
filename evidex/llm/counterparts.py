"""DuckDB counterparts of mixing, the manifest and conversation repair."""

from __future__ import annotations


def crc(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda c, b: {bits}), 4294967295)"


def mixing(seed: str = "mix") -> str:
    """Rounds of sharing are written out: each makes full what is above its bound; twenty serve twenty such steps."""
    rounds = ["f0 as (select *, false as full_ from ranked)"]
    for k in range(20):
        rate = f"(select (total - coalesce(sum(source_size * 2) filter (full_), 0)) / sum(weight) filter (not full_) from f{k}, whole group by total)"
        rounds.append(f"f{k + 1} as (select * exclude full_, full_ or coalesce(weight * {rate} > source_size * 2, false) as full_ from f{k})")
    rate = "(select (total - coalesce(sum(source_size * 2) filter (full_), 0)) / sum(weight) filter (not full_) from f20, whole group by total)"
    return rf"""
        with l as (select doc_id, power(4.0, avg(quality) - 0.5) as given from labels where doc_id is not null and quality is not null group by doc_id),
        d as (select d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, coalesce(given, 1.0) as given,
                     -ln((cast('0x' || substr(md5(concat_ws(':', '{seed}', cast(d.doc_id as varchar), coalesce(text, ''))), 1, 13) as bigint) + 0.5) / 4503599627370496.0) as drawn
              from documents d left join l on l.doc_id = d.doc_id),
        whole as (select sum(size) * 1.5 as total from d),
        s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        ranked as (select *, cast([3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as double) as weight from s),
        {", ".join(rounds)},
        t as (select source, source_size, case when full_ then cast(source_size * 2 as double) else weight * {rate} end as target from f20),
        o as (select *, coalesce(sum(size) over (partition by source order by drawn / given, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before from d),
        j as (select o.doc_id, o.size, t.source_size, t.target, o.before, cast(round(t.target) as bigint) as asked,
                     case when t.source_size > 0 then cast(round(t.target) as bigint) // t.source_size else 0 end as epochs
              from o join t on t.source is not distinct from o.source)
        select doc_id, size, source_size, target,
               cast(epochs * size + greatest(0, least(asked - epochs * source_size - before, size)) as bigint) as taken
        from j
    """


#: Levels that are written out: 8 to this power leaves, and as many groups.
LEVELS = 10


def merkle() -> str:
    from .merkle import FIELDS

    def leaf(text: str) -> str:
        value = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
        return f"sha256({' || '.join(value(c) for c in (*FIELDS[:4], text))})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""b as (select doc_id, lang, {leaf("text")} as leaf,
                   case when {crc("cast(doc_id as varchar)")} % 3 = 0 then {leaf(lower)} else {leaf("text")} end as changed from documents)""",
        "o as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from b)",
        "x0 as (select lang, i, leaf as d from o)",
    ]
    # Within a group, then over the groups: z0 are the subroots by their place.
    for name, base, group in (("x", "o", "lang"), ("z", "z0", "one")):
        if name == "z":
            parts.append("z0 as (select 1 as one, row_number() over (order by lang is not null, lang) - 1 as i, lang, d from x10)")
        for k in range(LEVELS):
            many = f"count(*) over (partition by {group}) > 1"
            parts.append(f"{name}m{k} as (select {group}, i, d, {many} as many from {name}{k})")
            parts.append(f"{name}r{k} as (select {group}, i // 8 as i, list(d order by i) as run, any_value(many) as many from {name}m{k} group by {group}, i // 8)")
            parts.append(f"{name}{k + 1} as (select {group}, i, case when many then sha256(array_to_string(run, '')) else run[1] end as d from {name}r{k})")
    parts.append("root as (select d as root from z10)")

    def climb(source: str, name: str, group: str, start: str) -> str:
        """Runs on the way up, with the row's place in each."""
        last = start
        for k in range(LEVELS):
            cte = f"{source}{k}"
            place = f"(c.{name}i // {8**k}) % 8"
            others = f"case when r.many then array_to_string(list_slice(r.run, 1, {place}), '') else '' end"
            after = f"case when r.many then array_to_string(list_slice(r.run, {place} + 2, 8), '') else '' end"
            fold = f"case when r.many then sha256({others} || c.folded || {after}) else c.folded end"
            parts.append(
                f"{cte} as (select c.* exclude (folded, proof), {fold} as folded, c.proof || {others} || {after} as proof from {last} c "
                f"join {source[0]}r{k} r on r.{group} is not distinct from c.{group} and r.i = c.{name}i // {8 ** (k + 1)})"
            )
            last = cte
        return last

    parts.append("xc as (select doc_id, lang, leaf, i as ai, changed as folded, '' as proof from o)")
    low = climb("xp", "a", "lang", "xc")
    parts.append(f"zc as (select l.*, z.one, z.i as bi, z.d as subroot from {low} l join z0 z on z.lang is not distinct from l.lang)")
    top = climb("zp", "b", "one", "zc")
    return f"""with {", ".join(parts)}
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from {top}, root"""


def conversations() -> str:
    said = lambda c: f"coalesce(cast({c} as varchar), ' ')"

    def more(script: str, cost: int | str, letters: str) -> str:
        """A script is its cost in nine digits and its letters, so the least text is the cheapest, then the ASCII-least."""
        return f"(lpad(cast(cast({script}[1:9] as bigint) + {cost} as varchar), 9, '0') || {script}[10:] || '{letters}')"

    inserted = f"""e, s, least(u, {more("e", 2, "I")}, {more("s", 2, "I")}, {more("a", 2, "I")}, {more("u", 4, "II")}) as u,
                   least(a, {more("u", 2, "I")}, {more("e", 4, "II")}, {more("s", 4, "II")}, {more("a", 4, "II")}) as a"""
    drop = lambda x: more(x, 3, "D")
    role = lambda x: f"case when fault not in ('blank', 'duplicate') then {more(x, '2 + late', 'R')} end"
    keep = lambda x, c: f"case when fault not in ('blank', 'duplicate') and first = '{c}' then {more(x, 'late', 'K')} end"
    return rf"""
        with recursive k as (select conv_id, turn, {said("role")} as role, {said("text")} as text, {crc(said("conv_id") + " || ':' || " + said("turn"))} % 20 as code from conversations),
        m as (select conv_id, turn, case when code = 4 then 'user' else role end as role,
                     case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                     unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
        n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos,
                     row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
                     regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare from m),
        f as (select *, left(role, 1) as first, case when bare = '' then 'blank' when again > 1 then 'duplicate'
                     when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from n),
        g as (select *, cast(fault = 'truncated' as int) as late, lag(first) over (partition by conv_id order by pos) as previous from f),
        ids as (select conv_id, coalesce(max(turn) filter (there), 0) - coalesce(min(turn) filter (there), 0) + cast(count(turn) filter (there) > 0 as int)
                       - count(distinct turn) filter (there) as gaps
                from (select conv_id, turn, code <> 0 as there from k) group by conv_id),
        tally as (select conv_id, count(*) as rows, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                         count(*) filter (fault = 'truncated') as truncated, count(*) filter (pos > 1 and previous || first not in ('su', 'ua', 'au')) as illegal
                  from g group by conv_id),
        walk as (
            select conv_id, cast(0 as bigint) as pos, '000000000' as e, cast(null as varchar) as s, cast(null as varchar) as u, cast(null as varchar) as a from ids
            union all
            select conv_id, pos, {drop("e")}, least({drop("s")}, {keep("e", "s")}),
                   least({drop("u")}, {role("e")}, {role("s")}, {role("a")}, {keep("e", "u")}, {keep("s", "u")}, {keep("a", "u")}),
                   least({drop("a")}, {role("u")}, {keep("u", "a")})
            from (select w.conv_id, g.pos, g.fault, g.first, g.late, {inserted}
                  from walk w join g on g.conv_id is not distinct from w.conv_id and g.pos = w.pos + 1)),
        ended as (select conv_id, least(e, a) as script from (
            select conv_id, {inserted} from walk w where not exists (select 1 from g where g.conv_id is not distinct from w.conv_id and g.pos = w.pos + 1))),
        letters as (select conv_id, i, script[9 + i] as edit, i - length(replace(script[10:9 + i], 'I', '')) as before_i,
                           length(replace(script[10:9 + i], 'I', '')) as pos
                    from (select conv_id, script, unnest(range(1, length(script) - 8)) as i from ended)),
        kept as (select l.conv_id, l.i, l.edit, g.role, case when l.edit = 'I' then '' else g.text end as text,
                        row_number() over (partition by l.conv_id order by l.i) - 1 as place
                 from letters l left join g on l.edit <> 'I' and g.conv_id is not distinct from l.conv_id and g.pos = l.pos where l.edit <> 'D'),
        placed as (select *, place - first_value(cast(edit = 'K' and left(role, 1) = 's' as int)) over (partition by conv_id order by place) as turn_no from kept),
        said as (select conv_id, sha256(string_agg(case when edit = 'K' then role when turn_no % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by place)) as sha
                 from placed group by conv_id)
        select ids.conv_id, cast(gaps as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, cast(script[1:9] as bigint) as cost, script[10:] as audit, coalesce(sha, sha256('')) as repaired_sha256
        from ids join ended on ended.conv_id is not distinct from ids.conv_id
        left join tally on tally.conv_id is not distinct from ids.conv_id
        left join said on said.conv_id is not distinct from ids.conv_id
    """
