"""The queries ``opN_<name>`` of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.quality import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.licenses import PATH_SQL, scan_licences

    files = _read(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{PATH_SQL.format(text='string')} AS path")
    return scan_licences(files)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from helixframe.llm.common import materialize
    from helixframe.llm.packing import decompose, number_sequences

    pieces = decompose(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return number_sequences(materialize(digests, "pieces"))


def op5_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.embeddings import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from helixframe.llm.mixing import mix_plan, with_position

    plan = mix_plan(_read(spark, sf_dir, "documents"))
    first = with_position(plan, F.lit(0), F.when(F.col("copies") > 0, F.col("size")).otherwise(F.col("part")))
    out = plan.withColumn("position", first).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("first_position"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from helixframe.llm.common import scratch_path
    from helixframe.llm.token_counts import token_counts

    counted = token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit")


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.common import scratch_path
    from helixframe.llm.warc import read_archives, write_archives

    manifest = write_archives(_read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from helixframe.llm.substrings import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_divergence": op1_quality_divergence,
        "op2_license_scan": op2_license_scan,
        "op3_minhash_neardup": op3_minhash_neardup,
        "op4_binary_packing": op4_binary_packing,
        "op5_lattice_neardup": op5_lattice_neardup,
        "op6_curriculum_mix": op6_curriculum_mix,
        "op7_token_counts": op7_token_counts,
        "op8_warc_dictionary": op8_warc_dictionary,
        "op9_toxicity": op9_toxicity,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    from helixframe.llm.oracles import all_oracles

    return all_oracles()
