"""Queries of the training-data operators over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import bpe, covertree, fim, mixing, nearest, quality, search, sharding, simhash, suffix, tokencounts, toxicity, whitening
from driftgauge.llm.training import fold

#: The public tokenizer file; the package that holds it is installed on every executor.
VOCABULARY = "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.dedup(table(spark, folder, "documents").select("doc_id", "text"), keep="none").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_covertree(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label")) \
        .select("vec_id", "n_links", "component_id", "kept")


#: Cosines of all pairs of one label; components as the closure of the links.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS MATERIALIZED (SELECT a.r AS ar, b.r AS br, b.vec_id AS bv FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
        WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
c AS (SELECT ar, br, bv FROM l UNION SELECT c.ar, l.br, l.bv FROM c JOIN l ON c.br = l.ar)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT ar, count(*) AS n FROM l GROUP BY ar) n ON n.ar = v.r LEFT JOIN (SELECT ar, min(bv) AS m FROM c GROUP BY ar) m ON m.ar = v.r"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), with_ids=False).drop("text")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, with_text=False).select("doc_id", "fingerprint", "component_id")


#: Ids 0 to 50255 are tokens; the next one is free.
FLAT_VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50_256


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokencounts.document_counts(docs, public_tokenizers.path(FLAT_VOCABULARY), SEPARATOR)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, field).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, chain).drop("text")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                                   F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('9:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
m AS (SELECT *, CAST(round(target) AS BIGINT) - times * source_size AS need FROM n),
x AS (SELECT d.doc_id, d.source, d.size, m.source_size, m.target, m.times, m.need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS tied
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target,
  CAST(times * size + CASE WHEN need <= upto - tied THEN 0 WHEN upto <= need THEN size
       ELSE least(size, floor((need - upto + tied) * size / tied)) END AS BIGINT) AS taken
FROM x"""

def op10_search(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every turn of a conversation whose id is divisible by 20, whole; against all turns of all conversations."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return search.top_k(turns, F.col("conv_id") % 20 == 0, ["conv_id", "turn"]).withColumn("score", F.round("score", 6))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, conv_id, turn,
             regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM conversations),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
m AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
s AS (SELECT q.r AS q, b.r AS r, round(sum(q.tf * ln(1 + (m.n - f.df + 0.5) / (f.df + 0.5)) * b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * len(d.w) / m.mean))), 9) AS score
      FROM p q JOIN d dq ON dq.r = q.r AND dq.conv_id % 20 = 0 JOIN f ON f.t = q.t JOIN p b ON b.t = q.t JOIN d ON d.r = b.r CROSS JOIN m
      GROUP BY q.r, b.r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d.conv_id NULLS LAST, d.turn NULLS LAST, s.r) AS rank FROM s JOIN d USING (r))
SELECT dq.conv_id AS q_conv_id, dq.turn AS q_turn, k.rank, k.conv_id, k.turn, round(k.score, 6) AS score FROM k JOIN d dq ON dq.r = k.q WHERE k.rank <= 10"""



def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100; against all vectors."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.search(nearest.build_index(vectors), vectors.filter("vec_id % 100 = 0"))


def op12_whitening(spark: SparkSession, folder: str, most: int = 8) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    explained = [None] * most if model is None else model.explained[:most]
    error = None if model is None else whitening.identity_error(vectors, model, most)
    rows = whitening.apply(vectors, model, most).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.element_at(F.lit(explained).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    cut = fim.restore(fim.transform(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
             sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(('0x' || substr(x, 1, 8)) AS UBIGINT) AS h1, CAST(('0x' || substr(x, 9, 8)) AS UBIGINT) AS h2,
        CAST(('0x' || substr(x, 17, 8)) AS UBIGINT) AS h3, CAST(('0x' || substr(x, 25, 8)) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""

QUERIES: dict[str, Query] = {
    "op1_suffix": op1_suffix, "op2_covertree": op2_covertree, "op3_bpe": op3_bpe, "op4_simhash": op4_simhash, "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality, "op7_toxicity": op7_toxicity, "op8_sharding": op8_sharding, "op9_mixing": op9_mixing, "op10_search": op10_search,
    "op11_nearest": op11_nearest, "op12_whitening": op12_whitening, "op13_fim": op13_fim}
ORACLES: dict[str, str] = {"op2_covertree": OP2_SQL, "op9_mixing": OP9_SQL, "op10_search": OP10_SQL, "op13_fim": OP13_SQL}
