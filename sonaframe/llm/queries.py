"""The registered ``opN_*`` queries: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .covertree import top_inner_products
from .decontam import contaminated
from .hardneg import hard_negatives
from .kdshards import kd_shards
from .knlm import score_texts
from .lexical import ranked_documents
from .licenses import scan_licenses
from .neardup import near_duplicates
from .packing import pack
from .pages import extract_pages
from .passages import cut_passages
from .quality import fit_quality, score_quality
from .shared import doc_texts, table
from .suffixes import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


def crc_of_id(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary"))


@_query("op10_quality_votes")
def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels learnt only where crc32(doc_id) mod 5 is not 0."""
    docs = doc_texts(table(spark, sf_dir, "documents"))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=crc_of_id() % 5 != 0)
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@_query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; the row with doc_id = class_id is the one to keep."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query("op9_contaminated")
def op9_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the share of its shingles."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op6_repeated_passages")
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that an earlier document holds."""
    return cut_passages(doc_texts(table(spark, sf_dir, "documents")))


@_query("op5_pack_sequences")
def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@_query("op2_page_text")
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


@_query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License and rights notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


@_query("op4_kd_shards")
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)


@_query("op7_cover_tree_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op7_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


@_query("op8_kneser_ney")
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and Kneser-Ney score of every document; the fold crc32(doc_id) mod 7 = 2 is not learnt from."""
    return score_texts(table(spark, sf_dir, "documents"), folds=7, fold=2)


@_query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


@_query("op12_ranked_documents", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS tokens FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * (SELECT docs FROM s) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS weight FROM t GROUP BY term),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tokens)) AS impact FROM t, s),
r AS (SELECT item_id, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM b JOIN i USING (term) JOIN w USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
""")
def op12_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@_query("op13_suffix_dedup")
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, with_kept=False)
