"""Token counts with a digest cache.

A text is keyed by the SHA-256 of its normalised content (runs of ASCII white space
become one space, none at the ends - which changes no count under a vocabulary that
drops white space) and by the digest of the vocabulary file.  Known keys are joined to
their stored counts; of the others each distinct text is encoded once, and the new
counts are appended to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import discard, map_batches, materialize, parted, texts_of
from helixframe.llm.tokens import tokenizer_version, word_counts

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def content_digest(text):
    """SHA-256 (binary) of a text with its ASCII white space normalised."""
    plain = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")
    return F.unhex(F.sha2(F.trim(plain), 256))


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's rows of one tokenizer version; none where the cache does not exist yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.range(0).selectExpr("cast(null AS binary) AS digest", "cast(null AS string) AS version", "cast(null AS long) AS n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    return rows.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens"))  # a job that ran twice appended twice


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row; the cache at ``cache_path`` gains the misses.

    A null text counts as empty.  Repeated rows and equal texts are encoded once, and rows that
    share an id are counted each by its own text.  Only texts that may be misses are shuffled.
    Other columns are ignored, whatever their names.  ``cache_path`` lies in a shared folder.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("m1", F.xxhash64("text")).withColumn("m2", F.xxhash64(F.lit(1), "text"))
    keys = materialize(keyed.select("doc_id", "m1", "m2", content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    cached = stored_counts(spark, cache_path, version)
    # One text stands for each distinct miss; equal texts are collapsed before they are shuffled.
    first = keys.groupBy("digest").agg(F.min(F.struct("m1", "m2")).alias("at")).join(cached, "digest", "left_anti")
    first = materialize(first.select("digest", F.col("at.m1").alias("m1"), F.col("at.m2").alias("m2")), "misses")
    wanted = parted(keyed, "m1", first)[0].groupBy("m1", "m2").agg(F.first("text").alias("text"))
    chosen = wanted.join(first, ["m1", "m2"]).select("digest", "text")

    def make():
        count = word_counts(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array(count(texts_of(batch.column("text"))), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("digest"), counts], names=["digest", "n_tokens"])

        return step

    fresh = map_batches(chosen, make, "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    discard(first)
    known = stored_counts(spark, cache_path, version).select("digest", "n_tokens")
    return keys.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")
