"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.common import SPACE, WORD, discard, written
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.mixing import mix
from millrace.llm.sentencepiece_codec import encode
from millrace.llm.simhash import near_keepers


def _named(rows: DataFrame, doc_id: str, key: Column) -> DataFrame:
    """Rows with the two columns by which they are met: the id as text (null is empty), and a key."""
    return rows.withColumn("__id", F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))).withColumn("__key", key)


def _keep(docs: DataFrame, key: Column, keepers: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``keepers`` (``keep_id, keep_key``, distinct), nulls included: of rows with its id and ``key`` the one
    with the longest text, then the smallest. Texts are shuffled once: what is joined by is also what is grouped by."""
    by = ["__id", "__key"]
    found = _named(docs, "doc_id", key).join(_named(keepers, "keep_id", F.col("keep_key")).select(*by), by, "left_semi")
    order = F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("__neg"), *docs.columns)
    return found.groupBy(*by).agg(F.min(order).alias("__row")).select(*(F.col(f"__row.{c}").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null or letterless texts); the others have the language that was found as ``lang``."""
    model = langid.learn(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model, pred_col="__lang", score_col="__score").filter(F.col("__lang") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_key")).distinct()
    return _keep(docs, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "").cast("binary"), 256), kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate component stays."""
    return _keep(docs, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), near_keepers(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or one to three times.

    Rows of the same id, source and size are alike to the mix: of each kind it is told how many are taken three times, twice and once, and
    that many get as much, in order of their texts. Texts are shuffled once, by kind."""
    kind = ["__id", "__source", "__size"]

    def named(rows: DataFrame, size: Column) -> DataFrame:
        keyed = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        return keyed.withColumn("__size", size)

    mine = named(docs, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    upto = [F.count(F.when(F.col("copies") >= n, 1)).alias(f"__{n}") for n in (3, 2, 1)]
    taken = named(mix(docs).filter("copies > 0"), F.col("size")).groupBy(*kind).agg(*upto)
    number = F.row_number().over(Window.partitionBy(*kind).orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    # one short row for each kind is hashed, so that texts are sorted once, for their numbers
    rows = mine.join(taken.hint("shuffle_hash"), kind).withColumn("__number", number).filter(F.col("__number") <= F.col("__1"))
    copies = F.when(F.col("__number") <= F.col("__3"), 3).when(F.col("__number") <= F.col("__2"), 2).otherwise(1)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot express the stages of hypervectors, cube sampling and tokenization.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is written and removed as soon as the next one is; the last stage reads the one that is left."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            if last is not None:
                discard(last)
            last = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
