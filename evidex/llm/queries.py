"""The queries of this subpackage, by name, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counterparts
from .conversations import damaged, repair_report
from .exact_dedup import exact_dedup
from .licences import licence_scan
from .licences import oracle as licence_oracle
from .line_dedup import line_dedup
from .media import media_column, media_features
from .merkle import folded, manifest, proof_digest, tampered
from .mixing import label_weights, mix
from .packing import pack
from .piece_codec import decoded_digest, encode_pieces
from .repeats import remove_repeats
from .simhash import near_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).drop("text_hash")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(_documents(spark, sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(_documents(spark, sf_dir))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_documents(spark, sf_dir))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return decoded_digest(encode_pieces(_documents(spark, sf_dir), path), path)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(_documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_documents(spark, sf_dir), label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    again = folded(F.col("changed"), F.col("places"), F.col("proof")).alias("folded_root")
    told = manifest(docs, tampered(docs)).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_licence_scan": op2_licence_scan,
    "op3_toxicity": op3_toxicity,
    "op4_piece_codec": op4_piece_codec,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_media": op7_media,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_repeats": op10_repeats,
    "op11_mixing": op11_mixing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op11_mixing": counterparts.mixing(),
    "op12_merkle_manifest": counterparts.merkle(),
    "op13_conversation_repair": counterparts.conversations(),
    "op10_repeats": r"""
        with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select doc_id, p, array_slice(b, p + 1, p + 50) as w from d, unnest(range(n - 49)) as t(p)),
        m as (select w, min(doc_id) as least from w group by w),
        g as (select w.doc_id, w.p, lag(w.p) over (partition by w.doc_id order by w.p) as before
              from w join m on m.w = w.w where m.least < w.doc_id),
        i as (select doc_id, p, sum(case when p <= before + 50 then 0 else 1 end) over (partition by doc_id order by p) as k from g),
        r as (select doc_id, k, min(p) as low, max(p) + 50 as high from i group by doc_id, k),
        s as (select *, coalesce(lag(high) over (partition by doc_id order by low), 0) as open from r),
        x as (select s.doc_id, sum(high - low) as n_removed, count(*) as n_spans,
                     string_agg(case when low > open then hex(array_slice(b, open + 1, low)) else '' end, '' order by low)
                         || case when max(high) < any_value(n) then hex(array_slice(any_value(b), max(high) + 1, any_value(n))) else '' end as kept
              from s join d on d.doc_id = s.doc_id group by s.doc_id)
        select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
               case when kept is null then sha256(b) else sha256(unhex(kept)) end as kept_sha256
        from d left join x on x.doc_id = d.doc_id
    """,
    "op2_licence_scan": licence_oracle(),
    "op1_exact_dedup": r"""
        with t as (
            select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal
            from documents)
        select doc_id,
               first_value(doc_id) over (partition by normal order by n desc, doc_id) as keep_id,
               count(*) over (partition by normal) as group_size,
               row_number() over (partition by normal order by n desc, doc_id) = 1 as kept,
               sha256(normal) as text_sha256
        from t
    """,
    "op9_line_dedup": r"""
        with t as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        k as (
            select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from t),
        c as (
            select key, max(doc_id) as last from k where length(key) >= 20
            group by key having count(distinct doc_id) >= 3),
        m as (
            select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.last as gone
            from k left join c on k.key = c.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from m group by doc_id
    """,
}
