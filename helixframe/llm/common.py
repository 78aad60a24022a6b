"""What the operators of this subpackage share: scratch tables, word splitting,
word hashing and connected components.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names, which driver
and executors share; only where it is unset and the master is local (tests) a
temporary folder is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.shipping import arrow_map

#: One word of the contracts: a run of characters other than space and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_helixframe_path", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def in_file_order(df: DataFrame) -> DataFrame:
    """``df`` with ``file_no`` and ``row_no``: where a row lies in the files that Spark wrote, in the order it wrote them.

    A table that comes from no files has the order in which it is read.
    """
    try:
        out = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("row_no"))
    except AnalysisException:
        at = df.withColumn("_at", F.monotonically_increasing_id())
        return at.withColumn("file_no", F.shiftright("_at", 33)).withColumn("row_no", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    # part-00012-<job>-c003: files of a task follow one another.
    part, chunk = (F.coalesce(F.regexp_extract("_file", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)"))
    return out.withColumn("file_no", part * 100_000 + chunk).drop("_file")


# --------------------------------------------------------------------------- joins of texts with few keys

#: Cells into which keys are hashed before texts are shuffled for them: at most so many rows are broadcast.
CELLS = 1 << 20


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` may be among ``keys``, and those whose key surely is not.

    Keys are hashed to ``CELLS`` cells; the set of cells, bounded whatever the keys, is broadcast.
    Only the first part need be shuffled for a join with the keys.  Null keys are in the second.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    marks = F.broadcast(keys.where(F.col(key).isNotNull()).select(cell.alias("_cell")).distinct())
    placed = rows.withColumn("_place", F.when(F.col(key).isNotNull(), cell))
    match = F.col("_place") == F.col("_cell")
    return placed.join(marks, match, "left_semi").drop("_place"), placed.join(marks, match, "left_anti").drop("_place")


# --------------------------------------------------------------------------- Arrow mapping


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return arrow_map(df, run, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """Python strings of a text column, one at a time; null becomes the empty text."""
    return (x.as_py() or "" for x in column)


# --------------------------------------------------------------------------- words


def words_of(text: str) -> list[bytes]:
    """The UTF-8 words of a text: ``bytes.split`` cuts at 0x20 and 0x09-0x0D exactly."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHasher:
    """128-bit hashes of words, kept for words seen before; bounded in memory."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.low = np.empty(1 << 14, dtype=np.uint64)
        self.high = np.empty(1 << 14, dtype=np.uint64)

    def _add(self, word: bytes) -> int:
        k = len(self.index)
        if k == len(self.low):
            self.low = np.concatenate([self.low, np.empty_like(self.low)])
            self.high = np.concatenate([self.high, np.empty_like(self.high)])
        both = xxhash.xxh3_128_intdigest(word)
        self.low[k] = both & 0xFFFFFFFFFFFFFFFF
        self.high[k] = both >> 64
        self.index[word] = k
        return k

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Indices of the words; they hold until the next call."""
        if len(self.index) > self.most:
            self._reset()
        get, add = self.index.get, self._add
        out = [get(w, -1) for w in words]
        if -1 in out:
            for i, k in enumerate(out):
                if k < 0:
                    w = words[i]
                    k = get(w, -1)
                    out[i] = add(w) if k < 0 else k
        return np.array(out, dtype=np.int64)


def rolling(values: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values, polynomials in ``multiplier`` mod 2**64 (by doubling)."""
    if len(values) < length:
        return np.empty(0, dtype=np.uint64)
    blocks, powers, size = {1: values}, {1: multiplier & 0xFFFFFFFFFFFFFFFF}, 1
    while size * 2 <= length:
        x, p = blocks[size], powers[size]
        blocks[size * 2] = x[:-size] * np.uint64(p) + x[size:]
        powers[size * 2] = p * p & 0xFFFFFFFFFFFFFFFF
        size *= 2
    out, done = blocks[size], size
    count = len(values) - length + 1
    out = out[:count] if done == length else out
    for part in sorted((s for s in blocks if s <= length - done and (length - done) & s), reverse=True):
        out = out[: len(values) - done - part + 1] * np.uint64(powers[part]) + blocks[part][done : len(values) - part + 1]
        done += part
    return out[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = values ^ (values >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(id, component_id)`` of every node of an undirected graph; component_id is the smallest id reachable.

    Rounds of contraction: every node moves to the best of itself and its neighbours,
    edges are renamed, loops go.  The first round prefers small ids, which settles
    stars at once; later ones prefer small hashes, so that chains shrink by a constant
    factor a round.  Each round ends in a scratch table; nothing reaches the driver but
    whether edges are left.  Self-loops give a component of one; null ends are ignored.
    An empty table of edges gives an empty result.
    """
    edges = materialize(
        edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(),
        "edges",
    )
    mapping, round_no, left_over = None, 0, edges
    spent = [edges]
    while True:
        both = left_over.select("a", "b").unionByName(left_over.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if round_no == 0:
            step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)).alias("h"), F.col(c).alias("n"))
            step = both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a")).getField("n").alias("to"))
        step = materialize(step, "step")
        spent.append(step)
        if mapping is None:
            mapping = step.select(F.col("a").alias("id"), F.col("to").alias("name"))
        else:
            moved = mapping.join(step, mapping["name"] == step["a"], "left").select("id", F.coalesce("to", "name").alias("name"))
            mapping = materialize(moved, "mapping")
            spent.append(mapping)
        renamed = (
            left_over.join(step.select(F.col("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        left_over = materialize(renamed, "edges")
        spent.append(left_over)
        round_no += 1
        if left_over.isEmpty():
            break
    smallest = mapping.groupBy("name").agg(F.min("id").alias("component_id"))
    out = materialize(mapping.join(smallest, "name").select("id", "component_id"), "components")
    discard(*spent)
    return out
