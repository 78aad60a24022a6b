"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` applies them in order, each on what the one
before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import discard, in_file_order, materialize
from helixframe.llm.mixing import mixed_documents
from helixframe.llm.neardup import without_copies
from helixframe.llm.packing import decompose, number_sequences
from helixframe.llm.substrings import without_repeats
from helixframe.llm.toxicity import learnt, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the toxicity classifier rejects go; every row is judged by its own text, with an id or without."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(*COLUMNS)
    return score(rows, learnt(labels, rows)).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of near duplicates (five-word shingles, 0.8) the smallest id stays.

    A row without an id stays: it can't be linked.
    """
    return without_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: repeated 50-word windows go; documents of which nothing is left go too.

    A document that loses words has the rest joined by single spaces; all others stay as they were.
    """
    cut = without_repeats(docs.select(*COLUMNS))
    return cut.where("n_removed = 0 OR text <> ''").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: the sources at their target weights; the rows and files written are in the order of training positions."""
    mixed = mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pieces of power-of-two lengths with their token ids, numbered as sequences.

    The order of training is that of the stage before: ``file_no`` and ``row_no`` name the copy of
    a document that a piece belongs to and order the copies, ``start`` the pieces of a copy.
    Sequences of one length are numbered in that order.  ``ids`` are little-endian unsigned 32-bit.
    """
    import public_tokenizers

    place = ("file_no", "row_no")
    rows = in_file_order(docs.select("doc_id", "text"))
    pieces = decompose(rows, public_tokenizers.path("byte_bpe_50k.json"), carry=place)
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return number_sequences(pieces, F.col("file_no"), (*place[1:], "start"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express none of the classifier, the signatures and the tokenizer: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}-{name}")
            discard(before)  # written in full: the stage before is read no more
    return docs
