"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of
the longest allowed length as fit, then the binary digits of the rest, longest first.
Every piece is a sequence of its own, so no sequence crosses documents and, each
length being a power of two, none is padded.  Sequences are numbered bucket by bucket
(equal lengths together), so that batches of one length are ranges of numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, texts_of
from helixframe.llm.tokens import bpe_ids

LONGEST, END_ID = 2048, 1
#: Pieces of one length that a task numbers.
PER_BLOCK = 200_000


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two, longest first, that sum to n."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens)`` and the columns to ``carry``; ``ids`` are little-endian unsigned 32-bit.

    A null text counts as empty: its only token is the end id.  Texts are taken whole.
    Repeated rows and rows that share an id are each cut up.  Other columns are ignored.
    """

    def make():
        encode = bpe_ids(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, start, length, ids, total = [], [], [], [], []
            for k, text in enumerate(texts_of(batch.column("text"))):
                own = np.append(encode(text), np.uint32(end_id)).astype("<u4").tobytes()
                at, n = 0, len(own) // 4
                for size in binary_lengths(n, longest):
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    ids.append(own[4 * at : 4 * (at + size)])
                    total.append(n)
                    at += size
            long, take = pa.int64(), pa.array(row, pa.int32())
            arrays = [batch.column("doc_id").take(take), pa.array(start, long), pa.array(length, long), pa.array(ids, pa.binary()), pa.array(total, long), *(batch.column(c).take(take) for c in carry)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", *carry])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"
    return map_batches(rows, make, ", ".join([schema, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)]))


def number_sequences(pieces: DataFrame, block=None, order: tuple[str, ...] = (), per_block: int = PER_BLOCK) -> DataFrame:
    """Add ``sequence_id`` (from 0, without gaps, longest bucket first) and ``offset`` (0).

    Pieces of one length are numbered block by block, and inside a block by ``order``.  Without
    ``block`` (a column of integers) they are dealt into blocks by a hash, so many that one
    holds about ``per_block`` pieces.  Blocks are counted first; no task holds more than one
    block of one length.  ``pieces`` is read twice: pass a materialised table.
    """
    if block is None:
        blocks = 1 + pieces.count() // per_block
        block, order = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)), ("doc_id", "start", "doc_tokens")
    dealt = pieces.withColumn("_block", block)
    counts = dealt.groupBy("length", "_block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))  # 64 rows at most
    first = counts.withColumn("within", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(lengths), "length")
    first = first.select("length", "_block", (F.col("base") + F.col("within")).alias("_first"))
    inside = Window.partitionBy("length", "_block").orderBy(*order)
    return (
        dealt.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .join(first, ["length", "_block"])
        .withColumn("sequence_id", F.col("_first") + F.col("_rank"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_block", "_rank", "_first")
    )
