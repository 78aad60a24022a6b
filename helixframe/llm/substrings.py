"""Removal of repeated word windows with a count-min prefilter.

A window is ``WINDOW`` consecutive words.  Its anchor is the least hash of the
``GRAM``-word runs inside it, so equal windows have equal anchors and neighbouring
windows mostly share one.

Pass 1 counts, for each anchor, the documents that hold it in a count-min sketch of
``DEPTH`` rows.  Every partition fills its own, and sparse pieces of them are merged shard
by shard; what is left of a shard is the list of its cells with two documents or more.
The sketch only overestimates, so no repeated window is lost.  It follows the input in
size, four cells an anchor, and lies in a table: nothing of it is broadcast or collected.

Pass 2 keeps the anchors all of whose cells are in that list, by joins on the cell, and
reads the documents that hold one again.  Their windows under such an anchor are cut into
runs that share it, and grouped exactly: equal runs first (whole copies end here), then,
only where an anchor has different runs, their windows.  Hashes are 64-bit and compared
only under an equal 64-bit anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixframe.llm.common import WordHasher, discard, map_batches, materialize, mixed, parted, rolling, texts_of
from helixframe.shipping import arrow_map

WINDOW, GRAM = 50, 8
#: Rows of the sketch, the least bits of a row, and the bits of a shard's cells where rows are long enough.
DEPTH, LEAST_BITS, SHARD_CELL_BITS, MOST_SHARD_BITS = 3, 16, 18, 16
#: Anchors of which a task holds the cells at once.
HELD = 1 << 20
_A, _B = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def anchors_of(low: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window of the word hashes its anchor: the least gram hash inside it."""
    least = mixed(rolling(low, gram, _A))
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (span - size)], least[span - size :]) if span > size else least


def sketch_cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors + np.uint64(_B * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


def _words(text: str, window: int) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    return words if len(words) >= window else []


def shard_bits(bits: int) -> int:
    """Bits of a shard's number: a shard's cells fit in a task, and there are no more shards than reduce tasks can use."""
    return max(2, min(MOST_SHARD_BITS, bits - SHARD_CELL_BITS))


def sketch_bits(anchors: int) -> int:
    """Bits of a sketch row for this many anchors: four cells an anchor."""
    return int(max(LEAST_BITS, np.ceil(np.log2(max(1.0, 4.0 * anchors)))))


def _anchors(window: int, gram: int):
    """mapInArrow step: the distinct anchors of each text that has a window."""

    def make():
        hasher = WordHasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, found = [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                words = _words(text, window)
                if words:
                    at = hasher.ids(words)
                    row.append(i)
                    found.append(np.unique(anchors_of(hasher.low[at], window, gram)).view(np.int64))
            take = pa.array(row, pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = pa.array(np.concatenate(found) if found else np.empty(0, dtype=np.int64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("mark").take(take), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "mark", "anchors"])

        return step

    return make


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _partition_sketch(bits: int):
    """mapInArrow function: this partition's sketch as sparse, compressed shards."""
    per = 1 << (bits - shard_bits(bits))

    def pieces(found: np.ndarray) -> pa.RecordBatch:
        shards, blobs, pack = [], [], zstandard.ZstdCompressor(level=1)
        for r in range(DEPTH):
            cells, times = np.unique(sketch_cells(found, r, bits), return_counts=True)
            number = cells // per
            cut = np.flatnonzero(number[1:] != number[:-1]) + 1
            for own, n in zip(np.split(cells, cut), np.split(times, cut), strict=True):
                s = int(own[0]) // per
                shards.append(r << shard_bits(bits) | s)
                blobs.append(pack.compress(np.diff((own - s * per) * 2 + (n > 1), prepend=0).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_flat(batch.column("anchors")))
            size += len(held[-1])
            if size >= HELD:
                yield pieces(np.concatenate(held))
                held, size = [], 0
        if size:
            yield pieces(np.concatenate(held))

    return run


def _merge_shards(bits: int):
    """mapInArrow function over rows sorted by shard: the cells of each shard that count two documents or more.

    Cells are numbered through all rows of the sketch.
    """
    per = 1 << (bits - shard_bits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, current = zstandard.ZstdDecompressor(), None
        once = twice = np.zeros(0, dtype=bool)

        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(twice) + current * per)], names=["cell"])

        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if shard != current:
                    if current is not None:
                        yield done()
                    current, once, twice = shard, np.zeros(per, dtype=bool), np.zeros(per, dtype=bool)
                marked = np.cumsum(np.frombuffer(unpack.decompress(blob), dtype="<u4").astype(np.int64))
                cells = marked >> 1
                twice[cells[(marked & 1).astype(bool) | once[cells]]] = True
                once[cells] = True
        if current is not None:
            yield done()

    return run


def _placed(bits: int):
    """mapInArrow function: one row an anchor of a document, with its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("anchors")
            row, flat = pc.list_parent_indices(column), _flat(column)
            cells = [pa.array(sketch_cells(flat, r, bits) + (r << bits)) for r in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(flat.view(np.int64)), *cells], names=["doc_id", "mark", "anchor", *(f"c{r}" for r in range(DEPTH))])

    return run


def estimated_repeats(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """``(doc_id, mark, anchors)``: of each document the anchors that the sketch counts in two documents or more."""
    anchors = materialize(map_batches(rows.select("doc_id", "mark", "text"), _anchors(window, gram), "doc_id long, mark long, anchors array<long>"), "anchors")
    if bits is None:
        bits = sketch_bits(anchors.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)).alias("n")).first()["n"])
    partial = arrow_map(anchors.select("anchors"), _partition_sketch(bits), "shard int, cells binary")
    dealt = partial.repartition(F.col("shard")).sortWithinPartitions("shard")
    repeated = materialize(arrow_map(dealt, _merge_shards(bits), "cell long"), "cells")
    left = arrow_map(anchors, _placed(bits), "doc_id long, mark long, anchor long, " + ", ".join(f"c{r} long" for r in range(DEPTH)))
    for r in range(DEPTH):
        own = repeated.where((F.col("cell") >= r << bits) & (F.col("cell") < (r + 1) << bits))
        left = left.join(own, F.col(f"c{r}") == own["cell"], "left_semi").drop(f"c{r}")
    out = materialize(left.groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors")), "repeats")
    discard(anchors, repeated)
    return out


def _runs(window: int, gram: int):
    """mapInArrow step: the runs of windows under the anchors given with each text."""

    def make():
        hasher = WordHasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            anchor, run, row, starts, count, wins = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                at = hasher.ids(_words(text, window))
                least = anchors_of(hasher.low[at], window, gram)
                cut = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                wanted = batch.column("anchors")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                hashes = rolling(hasher.high[at], window, _B)
                seen: dict[tuple[int, int], list[int]] = {}  # equal runs of one document are one row
                for k in np.flatnonzero(np.isin(least[cut[:-1]], wanted)):
                    own = hashes[cut[k] : cut[k + 1]].tobytes()
                    key = (int(least[cut[k]]) - 2**63, xxhash.xxh3_64_intdigest(own) - 2**63)
                    if key in seen:
                        seen[key].append(int(cut[k]))
                        continue
                    seen[key] = [int(cut[k])]
                    anchor.append(key[0])
                    run.append(key[1])
                    row.append(i)
                    starts.append(seen[key])
                    count.append(int(cut[k + 1] - cut[k]))
                    wins.append(np.frombuffer(own, dtype=np.int64))
            long = pa.int64()
            take = pa.array(row, pa.int32())
            ends = pa.array(np.cumsum([0, *count]), pa.int32())
            flat = pa.array(np.concatenate(wins) if wins else np.empty(0, dtype=np.int64), long)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor, long), pa.array(run, long), batch.column("doc_id").take(take), batch.column("mark").take(take), pa.array(starts, pa.list_(long)), pa.array(count, long), pa.ListArray.from_arrays(ends, flat)],
                names=["anchor", "run", "doc_id", "mark", "starts", "n", "wins"],
            )

        return step

    return make


_RUNS = "anchor long, run long, doc_id long, mark long, starts array<long>, n long, wins array<long>"


def _left(text: str, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those outside the spans."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not spans:
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        edge[min(s["start"], len(words))] += 1
        edge[min(s["stop"], len(words))] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            n, words = _left(text, spans)
            total.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their texts cut and the words removed counted; all other columns pass."""
    for batch in batches:
        removed, kept = [], []
        for text, spans in zip(texts_of(batch.column("text")), batch.column("_spans").to_pylist(), strict=True):
            n, words = _left(text, spans)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        names = [c for c in batch.schema.names if c != "_spans"]
        yield pa.RecordBatch.from_arrays([*(pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names), pa.array(removed, pa.int64())], names=[*names, "n_removed"])


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """``(doc_id, mark, spans)`` of the documents that lose words; spans are ``(start, stop)`` in words.

    Reads ``doc_id``, ``text`` and ``mark``, the hash of the text.  A window goes where its words
    also start in a document of smaller ``doc_id``.  Rows of one id and text are one document.
    """
    repeats = estimated_repeats(rows, window, gram, bits)
    texts = parted(rows, "doc_id", repeats)[0].groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    again = texts.join(repeats, ["doc_id", "mark"])
    runs = materialize(map_batches(again, _runs(window, gram), _RUNS), "runs")

    first = materialize(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("owner")), "owners")
    whole = runs.select("anchor", "run", "doc_id", "mark", "starts", "n").join(first, ["anchor", "run"]).where("doc_id > owner")
    whole = whole.select("doc_id", "mark", "n", F.explode("starts").alias("start"))
    spans = whole.select("doc_id", "mark", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop"))

    several = first.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    owned = runs.join(first.join(several, "anchor", "left_semi"), ["anchor", "run"]).where("doc_id = owner")
    windows = materialize(owned.select("anchor", "doc_id", "mark", "starts", F.posexplode("wins").alias("k", "win")), "windows")
    shared = windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("anchor", "win", "owner")
    single = windows.join(shared, ["anchor", "win"]).where("doc_id > owner").select("doc_id", "mark", "k", F.explode("starts").alias("start"))
    single = single.select("doc_id", "mark", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + window).alias("stop"))
    out = materialize(spans.unionByName(single).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(repeats, runs, first, windows)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for every row; kept words are joined by one space.

    Reads ``doc_id`` and ``text``; other columns are ignored.  A null text has no words.  A
    row without an id neither loses words nor takes them from others.  Rows that share an id
    don't take words from each other, and each loses its own.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    lists = repeated_spans(rows.where("doc_id IS NOT NULL"), window, gram, bits)
    hit, rest = parted(rows, "doc_id", lists)  # most texts lose nothing and need not be shuffled
    both = hit.join(lists, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    both = both.unionByName(rest.select("doc_id", "text", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))
    return arrow_map(both, _kept, "doc_id long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """``docs`` with the texts that lose words cut, and ``n_removed``; all other texts stay as they are.

    The rules are those of `remove_repeats`.  ``docs`` is read more than once: pass a table.
    """
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_mark", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = keyed.select(F.col("_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("_mark").alias("mark"))
    lists = repeated_spans(rows.where("doc_id IS NOT NULL"), window, gram, bits).toDF("_id", "_mark", "_spans")
    hit, rest = parted(keyed, "_id", lists)
    both = hit.join(lists, ["_id", "_mark"], "left").select(*docs.columns, "_spans")
    schema = StructType([*docs.schema.fields, StructField("n_removed", LongType())])
    cut = arrow_map(both.where("_spans IS NOT NULL"), _cut, schema)
    same = both.where("_spans IS NULL").drop("_spans").unionByName(rest.select(*docs.columns)).withColumn("n_removed", F.lit(0).cast("long"))
    return same.unionByName(cut)
