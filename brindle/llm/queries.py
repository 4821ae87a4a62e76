"""The queries of problems 3 and 6 to 8, and SQL where it can say what they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.encode import decode_ids, encode_texts
from brindle.llm.packing import fill_containers
from brindle.llm.residue import find_residue
from brindle.llm.termfreq import BUDGET, mark_terms, term_counts
from brindle.operators.hotkeys import clean_code
from brindle.session import stage, table

#: Tokens that a container of problem 7 holds.
CAPACITY = 2048


def _terms(spark: SparkSession, sf: str, **more: int) -> DataFrame:
    ontime = table(spark, sf, "ontime")
    code = lambda c: clean_code(F.col(c))
    return mark_terms(term_counts(ontime, {"airport": [code("origin"), code("dest")], "tail": [code("tailnum")]}, **more), ontime.count())


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).filter("mark is not null").select("vocabulary", "term", "mark")


def p3_spilled(spark: SparkSession, sf: str) -> DataFrame:
    """All terms once more, with so small a budget that pieces are spilled again and again."""
    return _terms(spark, sf, partitions=4, budget=BUDGET >> 14)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"), "text", ["doc_id"])


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return decode_ids(p6_ids(spark, sf), "ids", ["doc_id"])


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return fill_containers(table(spark, sf, "documents"), "doc_id", "text", capacity=CAPACITY)


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every text once and whole, none too full, none divided without need, and hardly more than the least number."""
    documents = table(spark, sf, "documents").filter("text <> ''").select("doc_id")
    placed = stage(p7_containers(spark, sf), "placed")
    fill = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count(F.lit(1)).alias("containers"), F.max("container_id").alias("last"), F.coalesce(F.sum((F.col("t") > CAPACITY).cast("long")), F.lit(0)).alias("too_full"), F.sum("t").alias("tokens"))
    each = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("top"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("t"))
    wrong = (F.col("n") != F.col("pieces")) | (F.col("top") + 1 != F.col("n")) | (F.col("end") != F.col("t"))
    needless = (F.col("n") > 1) & (F.col("t") <= CAPACITY)
    sound = each.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("not_whole"), F.coalesce(F.sum(needless.cast("long")), F.lit(0)).alias("divided"))
    missing = documents.join(placed.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    few = F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY) * 1.01 + 1
    totals = sound.unionByName(fill, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)
    one = totals.agg(*[F.max(c).alias(c) for c in totals.columns])
    return one.select("documents", "missing", "not_whole", "divided", "too_full", (F.col("last") + 1 - F.col("containers")).alias("holes"), few.alias("few"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_residue(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    return find_residue(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", *[F.round(c, 4).alias(f"{c}_share") for c in ("placeholder", "filler", "notice")])


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p3_spilled, p6_ids, p6_decoded, p7_containers, p7_check, p8_found, p8_classes)}

_TERMS = """
w AS (SELECT row_id, upper(trim(origin, ' ')) AS o, upper(trim(dest, ' ')) AS d, upper(trim(tailnum, ' ')) AS t FROM ontime),
e AS (SELECT 'airport' AS vocabulary, o AS term, row_id FROM w UNION ALL SELECT 'airport', d, row_id FROM w UNION ALL SELECT 'tail', t, row_id FROM w),
c AS (SELECT vocabulary, term, count(*) AS n_occurrences, count(DISTINCT row_id) AS n_records FROM e WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 50 > (SELECT count(*) FROM ontime) THEN 'common' END AS mark FROM c)"""
SQL = {
    "p3_found": f"WITH {_TERMS} SELECT vocabulary, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT * FROM m",
    "p3_spilled": f"WITH {_TERMS} SELECT * FROM m",
    "p7_check": "SELECT COUNT(*) AS documents, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS holes, TRUE AS few FROM documents WHERE text <> ''",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
