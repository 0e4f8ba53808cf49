"""One registered query for each operator, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ball_search, decontamination, langid, mil, mixing, sharding, spm, suffix_dedup, toxicity, warc, whitening
from .common import table_of
from .compression_bands import compression_bands
from .ngram_join import ngram_join
from .role_repair import repair_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# two regions of two racks of four shards; one more shard opens a region
SHARD_TREE = sharding.tree(2, 2, 4)
GROWN_TREE = sharding.grown(SHARD_TREE)


def _shard_sql(node: sharding.Node) -> str:
    """The descent as nested CASEs over the children's draws."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _shard_sql(node.children[0])
    draws = [
        f"-ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{c.name}'), 1, 13))::BIGINT + 0.5)"
        f" / 4503599627370496.0) / {c.weight}"
        for c in node.children
    ]
    least = f"least({', '.join(draws)})"
    whens = " ".join(f"WHEN {d} = {least} THEN {_shard_sql(c)}" for d, c in zip(draws[:-1], node.children))
    return f"CASE {whens} ELSE {_shard_sql(node.children[-1])} END"


# CRC-32 byte by byte: the 256-entry table follows from the polynomial
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_OP1_SQL = f"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, {_CRC_STEP} FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda crc, byte: xor(crc >> 8, tab[xor(crc & 255, byte) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
), placed AS (
  SELECT *, 'key' AS law, {_shard_sql(SHARD_TREE)} AS shard, {_shard_sql(GROWN_TREE)} AS grown_shard FROM sized
), hashed AS (
  SELECT *, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32, shard, grown_shard)) AS h
  FROM placed
)
SELECT doc_id, size, text_crc32, law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM hashed
"""


@query("op1_hash_tree_shards", _OP1_SQL)
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table_of(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    sharded = sharding.with_shards(docs, "doc_id", SHARD_TREE)
    sharded = sharding.with_shards(sharded, "doc_id", GROWN_TREE, "grown_shard")
    placed = sharding.with_slots(sharded)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op2_ordinal_toxicity")
def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table_of(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.withColumn("held_out", mixing.held_out(F.col("doc_id")))


_OP3_SQL = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN owner IS NULL THEN 'response' ELSE 'revisit' END AS record_type, owner AS refers_to
FROM (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN strlen(payload) >= 1000
      THEN nullif(max(page_id) OVER (PARTITION BY payload), page_id) END AS owner
  FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages)
)
"""


@query("op3_warc_bundles", _OP3_SQL)
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_bundles(table_of(spark, sf_dir, "pages"), path)
    records = warc.read_bundles(spark, path, with_payload=False)
    return records.select(
        F.expr("try_cast(record_id AS long)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op4_compression_bands")
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_bands(docs, keep=["doc_id"])


@query("op5_role_repair")
def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_roles(turns).select(
        "conv_id", "turn", "role", "out_turn", "out_role", "action", "inserted", "appended", "cost", "rendered"
    )


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer's model file, which goes with the job."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def token_digests(encoded: DataFrame) -> DataFrame:
    """The digests of ``ids`` and ``decoded``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op6_distinct_chunk_pieces")
def op6_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(spm.encode(docs, piece_model(), keep=["doc_id"], decode=True))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join(docs).select("doc_id", "class_id", "rep_id", "n_links")


@query("op8_bm25_wand_decontamination")
def op8_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    index = decontamination.build_index(table_of(spark, sf_dir, "benchmark"))
    found = decontamination.find_matches(docs, index, keep=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query("op9_rank_order_language")
def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~mixing.held_out(F.col("doc_id"))))
    named = langid.identify(docs, profiles, keep=["doc_id"])
    return named.select("doc_id", mixing.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_attention_quality")
def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit(docs, table_of(spark, sf_dir, "labels"))
    scored = mil.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", mixing.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents
), q AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all({_LOWER}, '{_TERM}')) AS ts FROM benchmark
), asked AS (SELECT item, item_id, unnest(ts) AS t FROM q),
sized AS (SELECT uid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
shape AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
tf AS (
  SELECT uid, t, count(*) AS tf FROM (SELECT uid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY uid, t
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, shape GROUP BY t, docs
), scored AS (
  SELECT item, item_id, doc_id, uid,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN sized USING (uid), shape
  GROUP BY item, item_id, doc_id, uid
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id)
QUALIFY rank <= 10
"""


@query("op11_ball_tree_search", _OP11_SQL)
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank_documents(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "benchmark"))


@query("op12_bidiagonal_whitening")
def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table_of(spark, sf_dir, "embeddings"), "vec_id")


# windows compared by MD5 sums, one of all of them at a time
_OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), w AS (
  SELECT uid, p, md5(data[p + 1:p + 200]) AS m
  FROM (SELECT uid, data, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)
), starts AS (
  SELECT uid, p FROM (SELECT uid, p, count(*) OVER (PARTITION BY m) AS k FROM w) WHERE k > 1
), spans AS (
  SELECT uid, min(p) AS low, max(p) + 200 AS high FROM (
    SELECT uid, p, sum(fresh) OVER (PARTITION BY uid ORDER BY p) AS span FROM (
      SELECT uid, p, CASE WHEN p - lag(p) OVER (PARTITION BY uid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM starts))
  GROUP BY uid, span
), gaps AS (
  SELECT uid, low, high, coalesce(lag(high) OVER (PARTITION BY uid ORDER BY low), 0) AS since FROM spans
), cut AS (
  SELECT g.uid, count(*) AS n_spans, sum(high - low) AS gone, max(high) AS last,
    string_agg(hex(d.data[since + 1:low]), '' ORDER BY low) AS head
  FROM gaps g JOIN d USING (uid) GROUP BY g.uid
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN data ELSE unhex(head || hex(data[last + 1:n])) END) AS kept_sha256
FROM d LEFT JOIN cut USING (uid)
"""


@query("op13_suffix_array_dedup", _OP13_SQL)
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.remove_repeats(docs, keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
