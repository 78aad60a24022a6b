"""Mixing sources to target weights with a curriculum.

Targets: the sources share the total size by weight; none gets more than ``MOST`` times
its size, and what is over is shared again by weight.  That is a water level L with
target = min(MOST * size, L * weight); L follows from sorting the sources by the level
at which they fill up.

Curriculum: the weight of a source changes linearly over training time t in [0, 1].  Its
demand up to t is target * W(t) / W(1), W being the integral of the weight.  A source's
documents lie one after the other in hash order, copy after copy; the time at which
demand reaches the middle of a copy is its training position.  Reading copies by position
gives at every time the mix that the schedules ask for.

Everything is DataFrame operations.  Prefix sums run in two levels, over ``BUCKETS`` hash
buckets a source and inside each, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WORD_PATTERN, materialize

MOST = 3
#: Weights of the sources in order of their names, repeating, and their linear schedules (from, to) as factors.
WEIGHTS = (1.0, 2.0, 3.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hex digits of the document hash that name its bucket: 16 ** DIGITS buckets a source.
DIGITS = 3


def _cycle(values, rank):
    """The value of a sequence at ``rank`` mod its length, as a column."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: float = MOST) -> DataFrame:
    """``(source, source_size, rank, weight, w0, w1, target)`` from ``(source, source_size)``, a row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", _cycle(weights, F.col("rank")))
    rows = rows.withColumn("w0", _cycle([a for a, _ in schedules], F.col("rank"))).withColumn("w1", _cycle([b for _, b in schedules], F.col("rank")))
    rows = rows.withColumn("full", F.col("source_size") * float(most) / F.col("weight"))
    whole = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if exactly the sources before this one are full.
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The first source that its level does not fill sets the level of all that follow.
    rows = rows.withColumn("water", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(whole).getField("level"))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("source_size") * float(most), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")))
    return rows.select("source", "source_size", "rank", "weight", "w0", "w1", target.alias("target"))


def position(demand, w0, w1):
    """Training time in [0, 1] at which a linear schedule has met this share of its whole demand."""
    mean, bend = (w0 + w1) / 2, (w1 - w0) / 2
    # w0 t + bend t^2 = demand * mean, solved without cancellation.
    return F.coalesce(F.try_divide(2 * demand * mean, w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 4 * bend * demand * mean))), F.lit(0.0))


def row_hash(docs: DataFrame):
    """Column: MD5 of a row's id and text, by which the rows of a source are ordered."""
    text = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: float = MOST) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, first position.

    Reads ``doc_id``, ``text`` and ``source``; other columns are ignored.  A null text has size
    0 and is never taken; a null source is a source of its own, the last.  Whole copies come
    first; of the copy that the target cuts, one document a source may be taken in part.
    Rows that share an id are documents of their own; rows of one id and text are
    interchangeable.  An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_hash(docs).alias("hash"))
    rows = materialize(rows.withColumn("bucket", F.substring("hash", 1, DIGITS)), "sizes")

    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, schedules, most)
    frame = starts.withColumnRenamed("source", "s").join(targets.withColumn("t", F.col("source")).drop("source"), F.col("s").eqNullSafe(F.col("t"))).withColumnRenamed("bucket", "b").drop("t")

    inside = Window.partitionBy("source", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(frame, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    words = F.floor(F.col("target") + 0.5).cast("long")
    out = out.withColumn("offset", F.col("bucket_start") + F.col("inside")).withColumn("words", words)
    out = out.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("words") - F.col("copies") * F.col("source_size") - F.col("offset")))
    out = out.withColumn("part", part).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return out


def with_position(plan: DataFrame, copy, length):
    """Position of one copy: ``copy`` is its number from 0, ``length`` the words it takes."""
    middle = (copy * F.col("source_size") + F.col("offset") + length / 2.0) / F.col("target")
    return F.when(length > 0, position(F.least(F.lit(1.0), middle), F.col("w0"), F.col("w1")))


def _row_key(hash_, source):
    return F.concat(hash_, F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-")))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeated and sorted by training position.

    Each copy keeps all columns; the copy that the target cuts ends with its last word taken.
    Rows equal in id, text and source are taken as often as the plan takes them together, and
    carry the other columns of the least of them.  Columns of ``docs`` named as the helper
    columns here keep their values.
    """
    plan = mix_plan(docs, **parameters)
    plan = plan.select("hash", "source", "size", "taken", "copies", "part", "offset", "source_size", "target", "w0", "w1").where("taken > 0")
    number = F.posexplode(F.sequence(F.lit(1), (F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")))
    copies = plan.select("*", number.alias("mix_copy", "mix_n")).withColumn("mix_length", F.when(F.col("mix_copy") < F.col("copies"), F.col("size")).otherwise(F.col("part")))
    copies = copies.withColumn("mix_position", with_position(copies, F.col("mix_copy"), F.col("mix_length")))
    copies = copies.select(_row_key(F.col("hash"), F.col("source")).alias("mix_key"), "mix_copy", "mix_length", F.col("size").alias("mix_size"), "mix_position", F.col("offset").alias("mix_offset"))
    single = docs.select(_row_key(row_hash(docs), docs["source"]).alias("mix_key"), F.struct(*docs.columns).alias("mix_row"))
    single = single.groupBy("mix_key").agg(F.min("mix_row").alias("mix_row"))
    # The part taken ends with its last word.
    text = F.col("mix_row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("mix_length") == F.col("mix_size"), text).otherwise(F.array_join(F.slice(pieces, 1, F.col("mix_length").cast("int")), ""))
    order = ["mix_position", "mix_key", "mix_copy", "mix_offset"]
    out = copies.join(single, "mix_key").withColumn("mix_text", cut).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(*(F.col("mix_text").alias(c) if c == "text" else F.col("mix_row")[c].alias(c) for c in docs.columns))
