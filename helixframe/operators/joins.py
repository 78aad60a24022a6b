"""Similarity, nearest-neighbour and interval joins.

None of them needs all pairs of rows where the data allow less: Hamming and edit joins
turn into equi-joins on blocks (pigeonhole: k differences leave one of k + 1 blocks
intact), containment and genome hits into equi-joins on substrings, and the nearest
interval into a window over the ordered union of both sides.  Strings are made distinct
before they are joined, so copies cost one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import PER_WORD, kmers, letter_bits, packed, packed_differences, packed_hamming, reverse_complement
from helixframe.operators import nearest
from helixframe.session import checkpoint
from helixframe.shipping import ship

#: Frequent values that are looked for where rows are dealt, so many at most; any that is in one of so many rows is found.
COMMON = 256


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides.  Sizes are guessed from compressed files, before strings are
    derived and rows exploded, so a guess would let sides that grow with the data be broadcast by the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def settled(df: DataFrame) -> DataFrame:
    """Rows derived once and dealt over all tasks, for joins that read them several times; small files come in few partitions."""
    return checkpoint(df.repartition(df.columns[0]))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by a key before anything is derived from them; small files come in one or two partitions."""
    return df.repartition(max(df.rdd.getNumPartitions(), 3 * df.sparkSession.sparkContext.defaultParallelism), key)


def _spans(length: int, blocks: int) -> list[tuple[int, int]]:
    return [(i * length // blocks, (i + 1) * length // blocks) for i in range(blocks)]


def _blocks(df: DataFrame, text: str, spans: list[tuple[int, int]]) -> DataFrame:
    """``(text..., block, part)`` for the spans, exploded."""
    parts = F.array(*(F.struct(F.lit(i).alias("block"), F.substring(text, a + 1, b - a).alias("part")) for i, (a, b) in enumerate(spans)))
    return df.select("*", F.explode(parts).alias("_b")).select("*", F.col("_b.block").alias("block"), F.col("_b.part").alias("part")).drop("_b")


def _packed_blocks(df: DataFrame, name: str, spans: list[tuple[int, int]], length: int) -> DataFrame:
    """Distinct strings of a length as ``name`` with their packed form, one row a block."""
    own = df.where(F.length("text") == length).select("text").distinct()
    own = own.select("text", *(c.alias(f"{name}{k}") for k, c in enumerate(packed(F.col("text"), length))))
    return _blocks(own, "text", spans).withColumnRenamed("text", name)


def _met(left: DataFrame, right: DataFrame, spans: list[tuple[int, int]], most: int, length: int, also: Column | None = None) -> DataFrame:
    """``(a, b, distance)`` of blocked strings that share a block; a pair comes from the first block it shares only."""
    words = range(-(-length // PER_WORD))
    earlier = F.lit(False)
    for k, (x, y) in enumerate(spans[:-1]):
        earlier = earlier | ((F.col("block") > k) & (F.substring("a", x + 1, y - x) == F.substring("b", x + 1, y - x)))
    distance = packed_hamming([F.col(f"a{k}") for k in words], [F.col(f"b{k}") for k in words])
    met = sorted_join(left, right, ["block", "part"])
    met = met.where(also) if also is not None else met
    return met.withColumn("distance", distance).where((F.col("distance") <= most) & ~earlier).select("a", "b", "distance")


def hamming_pairs(left: DataFrame, right: DataFrame, most: int, length: int) -> DataFrame:
    """``(a, b, distance)`` of all pairs of distinct strings of a length at ``most`` substitutions.

    ``left`` and ``right`` have a column ``text``; the distance is verified on the candidates.  Strings are
    written once: expressions that derive them would be repeated in the filter, the grouping and the packing
    of one generated method, which the JVM then runs without compiling it.
    """
    spans = _spans(length, most + 1)
    left, right = (checkpoint(side.select("text")) for side in (left, right))
    return _met(_packed_blocks(left, "a", spans, length), _packed_blocks(right, "b", spans, length), spans, most, length)


def _named(pairs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Pairs of distinct strings ``(a, b, distance)`` as pairs of rows ``(i, j, distance)``, i < j, with those of equal strings."""
    apart = sorted_join(sorted_join(pairs, rows.toDF("i", "a"), "a"), rows.toDF("j", "b"), "b").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "distance").where("i < j")
    own = rows.where(F.length("text") == length)
    equal = sorted_join(own, own.toDF("j", "text"), "text").where("i < j").select("i", "j", F.lit(0).cast("long").alias("distance"))
    return apart.unionByName(equal)


def hamming_self_join(df: DataFrame, most: int, length: int, key: str = "sample_index", text: str = "sequence") -> DataFrame:
    """``(i, j, distance)`` with i < j: all pairs of rows at ``most`` substitutions.

    Distinct strings meet one way round; equal strings are paired by the rows alone.
    """
    rows = settled(df.select(F.col(key).alias("i"), F.col(text).alias("text")))
    spans = _spans(length, most + 1)
    pairs = _met(_packed_blocks(rows, "a", spans, length), _packed_blocks(rows, "b", spans, length), spans, most, length, F.col("a") < F.col("b"))
    return _named(pairs, rows, length)


def masked_self_join(df: DataFrame, length: int, groups: int, kept: int, most: int, key: str = "sample_index", text: str = "sequence") -> DataFrame:
    """Hamming self-join by wildcard masks: each of the ``groups`` segments is split in ``kept + 2`` parts and drops two of them at most.

    A pair with at most ``most`` substitutions agrees on the kept parts of one mask in one segment,
    as long as ``most < groups * 3``; where there is room to that bound, segments drop fewer parts.
    Masked strings are hashed, so a mask costs a row of numbers.
    """
    from itertools import combinations

    if most >= groups * 3:
        raise ValueError("a pair could break every mask")
    spare = groups * 3 - most - 1  # segments that need not drop so many: drops + 1, summed up, still exceed ``most``
    masks = []
    for g, (a, b) in enumerate(_spans(length, groups)):
        drops = max(0, 2 - len(range(g, spare, groups)))
        parts = [range(a + x, a + y) for x, y in _spans(b - a, kept + 2)]
        for gone in combinations(parts, drops):
            masks.append([p for p in range(a, b) if not any(p in part for part in gone)])
    count = -(-length // PER_WORD)
    nibbles = [[15 * bits for bits in letter_bits(m, length)] for m in masks]
    listed = F.expr("array(" + ", ".join("struct(" + ", ".join([f"{k} AS mask", *(f"{v}L AS m{i}" for i, v in enumerate(m))]) + ")" for k, m in enumerate(nibbles)) + ")")  # folds to a constant
    rows = settled(df.select(F.col(key).alias("i"), F.col(text).alias("text")))
    own = rows.where(F.length("text") == length).select("text").distinct().select("text", *(c.alias(f"w{k}") for k, c in enumerate(packed(F.col("text"), length))))
    own = settled(own)
    mark = F.xxhash64("m.mask", *(F.col(f"w{k}").bitwiseAND(F.col(f"m.m{k}")) for k in range(count)))  # a clash only adds a candidate
    marked = own.select(*(f"w{k}" for k in range(count)), F.explode(listed).alias("m")).select(*(f"w{k}" for k in range(count)), mark.alias("mark"))
    left, right = (marked.toDF(*(f"{name}{k}" for k in range(count)), "mark") for name in "ab")
    sides = {name: [f"{name}{k}" for k in range(count)] for name in "ab"}
    before = F.lit(False)
    for x, y in reversed(list(zip(sides["a"], sides["b"], strict=True))):
        before = (F.col(x) < F.col(y)) | ((F.col(x) == F.col(y)) & before)
    distance = packed_hamming([F.col(c) for c in sides["a"]], [F.col(c) for c in sides["b"]])
    met = sorted_join(left, right, "mark").where(before).withColumn("distance", distance)
    close = met.where(F.col("distance") <= most).select(*sides["a"], *sides["b"], "distance").distinct()
    for name in "ab":
        close = sorted_join(close, own.toDF(name, *sides[name]), sides[name])
    close = close.select("a", "b", "distance")
    return _named(close, rows, length)


def edit_pairs(queries: DataFrame, references: DataFrame, most: int, length: int) -> DataFrame:
    """``(a, b, distance)`` of distinct queries and references at ``most`` edits; references have one length.

    Of most + 1 blocks of a reference one occurs unchanged in the query, shifted by ``most`` at most.
    """
    spans = _spans(length, most + 1)
    ref = _blocks(references.where(F.length("text") == length).select("text").distinct(), "text", spans).withColumnRenamed("text", "b")
    probes = F.array(*(F.struct(F.lit(i).alias("block"), F.when(F.lit(a + s >= 0) & (F.length("text") >= b + s), F.substring("text", a + s + 1, b - a)).alias("part")) for i, (a, b) in enumerate(spans) for s in range(-most, most + 1) if a + s >= 0))
    own = queries.where(F.length("text").between(length - most, length + most)).select("text").distinct()
    ask = own.select(F.col("text").alias("a"), F.explode(probes).alias("p")).select("a", F.col("p.block").alias("block"), F.col("p.part").alias("part")).where("part IS NOT NULL").distinct()
    met = sorted_join(ask, ref, ["block", "part"])
    return met.select("a", "b", F.levenshtein("a", "b", most).cast("long").alias("distance")).where("distance >= 0").distinct()


def shifted_windows(df: DataFrame, text: str, start: int, width: int, shifts: range) -> DataFrame:
    """Every shift of a window in both orientations: adds ``shift``, ``orientation`` and ``window``; windows outside the string are left out."""
    out = df.select("*", F.explode(F.array(*(F.lit(s) for s in shifts))).alias("shift"))
    out = out.withColumn("window", F.when((F.lit(start) + F.col("shift") >= 0) & (F.lit(start) + F.col("shift") + width <= F.length(text)), F.substr(F.col(text), F.lit(start) + F.col("shift") + 1, F.lit(width))))
    both = F.array(F.struct(F.lit("forward").alias("orientation"), F.col("window")), F.struct(F.lit("reverse_complement").alias("orientation"), reverse_complement(F.col("window")).alias("window")))
    return out.where("window IS NOT NULL").withColumn("w", F.explode(both)).withColumn("orientation", F.col("w.orientation")).withColumn("window", F.col("w.window")).drop("w")


def best_witness(windows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Per key the least ``(distance, |shift|, shift, orientation, reference)`` among its windows' matches."""
    hits = sorted_join(windows, pairs.select(F.col("a").alias("window"), F.col("b").alias("reference"), "distance"), "window")
    best = F.min(F.struct("distance", F.abs("shift").alias("away"), "shift", "orientation", "reference")).alias("m")
    return hits.groupBy(key).agg(best).select(key, *(F.col(f"m.{c}").alias(c) for c in ("distance", "shift", "orientation", "reference")))


def membership(df: DataFrame, other: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """Rows of ``df`` with the sorted set of ``value`` that the equal strings of ``other`` have; null where there is none."""
    sets = other.groupBy(on).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(name))
    return df.join(sets, on, "left")


def unique_lookup(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Composite-key lookup with the number of matches; a caller that needs one of each filters on ``matches = 1``."""
    counted = other.groupBy(*keys).agg(F.count("*").alias("matches"))
    return df.join(counted, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))


def containment(short: DataFrame, long: DataFrame, width: int, key: str, long_key: str) -> DataFrame:
    """``(key, long_key, strand)``: strings of ``width`` that occur in longer ones, or their reverse complement does.

    The longer strings are cut into all their substrings of that width and joined by equality.
    """
    cut = long.select(long_key, F.explode(F.array_distinct(kmers(F.col("text"), width))).alias("part"))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("text").alias("part")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("text")).alias("part")))
    ask = short.where(F.length("text") == width).select(key, F.explode(both).alias("q")).select(key, F.col("q.strand").alias("strand"), F.col("q.part").alias("part"))
    return ask.join(cut, "part").select(key, long_key, "strand").distinct()


# --------------------------------------------------------------------------- nearest neighbours


def match_counts(queries: DataFrame, references: DataFrame, weights: list[float] | None = None, length: int = 50) -> DataFrame:
    """All ``(q, r, label, score)``: positions at which a query equals a reference, weighted where weights are given.

    ``queries`` are the stated query set ``(q, text)``, met by all references ``(r, text, label)``,
    both of strings of ``length``; the smaller side is broadcast only if the optimiser finds it
    small enough.  Strings are packed, so a pair costs a few operations on numbers.
    """
    words = range(-(-length // PER_WORD))
    pack = lambda name: [c.alias(f"{name}{k}") for k, c in enumerate(packed(F.col("text"), length))]
    pairs = queries.select("q", *pack("a")).crossJoin(references.select("r", "label", *pack("b")))
    differs = packed_differences([F.col(f"a{k}") for k in words], [F.col(f"b{k}") for k in words])
    score = F.lit(0.0)
    for w in sorted(set(weights or [1.0])):
        places = [p for p in range(length) if (weights[p] if weights else 1.0) == w]
        off = F.lit(0)
        for d, bits in zip(differs, letter_bits(places, length), strict=True):
            off = off + F.bit_count(d.bitwiseAND(F.lit(bits)))
        score = score + F.lit(float(w)) * (F.lit(len(places)) - off)
    return pairs.select("q", "r", "label", score.alias("score"))


@dataclass
class _Near:
    """What near copies mostly agree on: the hash of two parts of a text that follow each other, its most frequent values with their counts, of so many rows."""

    value: Column
    common: list[tuple[int, int]]
    rows: int


def _counted(sides: list[DataFrame], length: int) -> list[tuple[int, int, _Near]]:
    """Per side its rows, about its different texts, and the two parts of a text that follow each other with the fewest different contents."""
    spans = nearest.parts(length)
    windows = [F.xxhash64(*(F.substring("text", a + 1, b - a) for a, b in pair)) for pair in zip(spans, spans[1:] + spans[:1], strict=True)]
    both = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("side"), F.xxhash64("text").alias("x"), *(w.alias(f"w{k}") for k, w in enumerate(windows))) for i, df in enumerate(sides)))
    different = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c))
    common = lambda c: F.call_function("approx_top_k", F.col(c), F.lit(COMMON), F.lit(4 * COMMON))
    names = [f"w{k}" for k in range(len(windows))]
    found = {r[0]: r[1:] for r in both.groupBy("side").agg(F.count("*"), different("x"), F.array(*map(different, names)), F.array(*map(common, names))).collect()}
    out = []
    for i in range(len(sides)):
        rows, texts, counts, values = found.get(i, (0, 0, [0], [[]]))
        k = counts.index(min(counts))
        out.append((rows, texts, _Near(windows[k], [(v["item"], v["count"]) for v in values[k]], rows)))
    return out


def _dealt(df: DataFrame, near: _Near, blocks: int) -> DataFrame:
    """Rows with their ``block``, so that near copies meet; what would fill a fourth of a block is dealt by the first column instead."""
    if 4 * blocks > COMMON:  # not all such values may be known
        return df.repartitionByRange(blocks, near.value, F.col(df.columns[0])).withColumn("block", F.pmod(F.spark_partition_id(), F.lit(blocks)))
    hot = [v for v, n in near.common if 4 * n * blocks > near.rows]
    return df.withColumn("block", F.pmod(F.when(near.value.isin(hot), F.xxhash64(df.columns[0])).otherwise(near.value), F.lit(blocks)).cast("int"))


def _cells(queries: DataFrame, references: DataFrame, held: DataFrame, copies: int, function, schema: str, length: int) -> DataFrame:
    """``function`` on every block of queries with every block of ``held``: ``(q, text)`` and ``(text, ...)`` cut into blocks of bounded size.

    ``held`` is made from the references, with ``copies`` rows a text at most.  A cell has a task of its own.
    """
    spark = queries.sparkSession
    ship(spark)
    asked, references, held = (side.where("text IS NOT NULL") for side in (queries, references, held))
    (rows, _, near), (known, texts, alike) = _counted([asked, references], length)
    across, down = nearest.grid(rows, min(known, copies * texts), spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _dealt(asked, near, across).withColumnRenamed("block", "a").select("*", every(down).alias("h"))
    right = _dealt(held, alike, down).withColumnRenamed("block", "h").select("*", every(across).alias("a"))
    left, right = (side.select("*", (F.col("a") * down + F.col("h")).alias("cell")).drop("a", "h").repartitionById(min(4096, across * down), "cell") for side in (left, right))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(function, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def closest_levels(queries: DataFrame, references: DataFrame, k: int, weights: list[float] | None = None, tolerance: float = 0.0, length: int = 50) -> DataFrame:
    """``(q, score, n, known, labels)`` for `nearest_mean` and `nearest_k_fractional`: references, those with a label and the sum of
    labels by score, with every score from a query's best to its k-th less the tolerance.

    All queries ``(q, text)`` meet all references ``(r, text, label)``; references of one text are one row.
    """
    once = references.groupBy("text").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).cast("double").alias("labels"))
    return _cells(queries, references, once, 1, nearest.closest_levels(k, weights, tolerance, length), f"q {_kind(queries, 'q')}, score double, n long, known long, labels double", length)


def closest_rows(queries: DataFrame, references: DataFrame, k: int, length: int = 50) -> DataFrame:
    """``(q, r, label, score)`` for `nearest_first` and `nearest_k`, with the k best references of each query, ties to the lowest.

    All queries ``(q, text)`` meet all references ``(r, text, label)``; of references of one text the k lowest can be needed.
    """
    if k == 1:
        lowest = references.groupBy("text").agg(F.min("r").alias("r"), F.min_by("label", "r").alias("label")).select("r", "text", "label")
    else:
        lowest = references.withColumn("_k", F.row_number().over(Window.partitionBy("text").orderBy("r"))).where(F.col("_k") <= k).select("r", "text", "label")
    return _cells(queries, references, lowest, k, nearest.closest_rows(k, length), f"q {_kind(queries, 'q')}, r {_kind(references, 'r')}, label {_kind(references, 'label')}, score double", length)


def _by_score(scored: DataFrame) -> DataFrame:
    """``(q, score, n, known, labels)``: references, those with a label and the sum of their labels at each score of a query; summed before any shuffle.

    ``scored`` holds pairs ``(q, r, label, score)`` or such sums.
    """
    if "labels" in scored.columns:
        return scored.groupBy("q", "score").agg(*(F.sum(c).alias(c) for c in ("n", "known", "labels")))
    return scored.groupBy("q", "score").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.sum("label").alias("labels"))


def nearest_mean(scored: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per query: best score, number of references within the tolerance of it, and the mean of their labels."""
    best = F.max("score").over(Window.partitionBy("q"))
    near = _by_score(scored).withColumn("best", best).where(F.col("best") - F.col("score") <= tolerance)
    return near.groupBy("q", "best").agg(F.sum("n").alias("ties"), F.try_divide(F.sum("labels"), F.sum("known")).alias("prediction"))


def nearest_first(scored: DataFrame) -> DataFrame:
    """Per query the reference of highest score, ties to the lowest reference."""
    return scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("m"), "r", "label")).alias("x")).select("q", F.col("x.r").alias("r"), (-F.col("x.m")).alias("score"), F.col("x.label").alias("label"))


def _edge(scored: DataFrame, k: int) -> DataFrame:
    """``_by_score`` with ``edge``, the score of the k-th reference of a query; queries with fewer references are left out."""
    down = Window.partitionBy("q").orderBy(F.col("score").desc())
    counted = _by_score(scored).withColumn("upto", F.sum("n").over(down))
    return counted.withColumn("edge", F.max(F.when(F.col("upto") >= k, F.col("score"))).over(Window.partitionBy("q"))).where("edge IS NOT NULL")


def nearest_k(scored: DataFrame, k: int) -> DataFrame:
    """Exactly k references a query (all, where there are fewer), ties to the lowest reference: ``(q, prediction)``."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "r")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("q").agg(F.avg("label").alias("prediction"))


def nearest_k_fractional(scored: DataFrame, k: int, tolerance: float = 1e-10) -> DataFrame:
    """k references of weight in all: closer ones weigh 1, those tied at the boundary share the rest.

    Returns ``(q, prediction, contributors, boundary_ties, effective_size)``; the effective size is k^2 / sum of squared weights.
    """
    near = _edge(scored, k).where(F.col("score") >= F.col("edge") - tolerance).withColumn("tied", F.col("score") <= F.col("edge") + tolerance)
    part = lambda c, tied: F.sum(F.when(F.col("tied") == tied, F.col(c)).otherwise(0))
    sums = near.groupBy("q").agg(part("n", False).alias("closer"), part("n", True).alias("ties"), part("labels", False).alias("s1"), part("labels", True).alias("s2"))
    share = (F.lit(float(k)) - F.col("closer")) / F.col("ties")
    return sums.select(
        "q",
        ((F.col("s1") + share * F.col("s2")) / float(k)).alias("prediction"),
        (F.col("closer") + F.col("ties")).alias("contributors"),
        F.col("ties").alias("boundary_ties"),
        (F.lit(float(k) * k) / (F.col("closer") + share * share * F.col("ties"))).alias("effective_size"),
    )


# --------------------------------------------------------------------------- genomes and intervals


def genome_hits(reads: DataFrame, genome: str, width: int, key: str, text: str = "text", piece: int = 4096) -> DataFrame:
    """``(key, start, strand)``: all exact hits of strings of ``width`` on a circular genome, overlapping ones too.

    The genome is cut into overlapping pieces, and each piece into its substrings, so that a
    start costs the same wherever it lies.
    """
    ring = genome + (genome * (width // max(1, len(genome)) + 1))[: width - 1]
    rows = [(a, ring[a : min(a + piece, len(genome)) + width - 1]) for a in range(0, len(genome), piece)]
    pieces = reads.sparkSession.createDataFrame(rows, "at long, bases string")
    cuts = pieces.select("at", F.posexplode(kmers(F.col("bases"), width)).alias("k", "part")).select((F.col("at") + F.col("k")).alias("start"), "part")
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col(text).alias("part")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col(text)).alias("part")))
    ask = reads.where(F.length(text) == width).select(key, F.explode(both).alias("q")).select(key, F.col("q.strand").alias("strand"), F.col("q.part").alias("part"))
    return ask.join(cuts, "part").select(key, "start", "strand")


def circular_gap(queries: DataFrame, starts: DataFrame, length: int, width: int, per_bucket: int = 1 << 16) -> DataFrame:
    """``(q, gap)``: gap on a circle between each query interval and the nearest reference interval, null without references.

    Both are intervals of ``width`` from ``start``; the gap is the circular distance of the
    starts less the width, 0 at least.  References are repeated one turn before and after.
    Queries are made distinct first: there are ``length`` starts at most.  The circle is cut into
    buckets of ``per_bucket`` positions at most; each gets its references and the nearest one on
    either side, so windows run bucket by bucket and no task holds the whole circle.
    """
    buckets = max(64, -(-length // per_bucket))
    size = -(-length // buckets)
    refs = starts.select(F.col("start").cast("long").alias("start")).distinct()
    turns = refs.select(F.explode(F.array(F.col("start") - length, F.col("start"), F.col("start") + length)).alias("at"))
    turns = turns.withColumn("bucket", F.floor(F.col("at") / size).cast("long"))
    ends = turns.groupBy("bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))  # three rows a bucket of the circle at most
    ring = Window.orderBy("bucket")
    grid = queries.sparkSession.range(buckets).select(F.col("id").alias("bucket")).unionByName(ends.select("bucket")).distinct().join(ends, "bucket", "left")
    grid = grid.select("bucket", F.last("hi", True).over(ring.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(ring.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    asked = queries.select("q", F.col("start").cast("long").alias("at"))
    own = asked.select("at").distinct().select("at", F.floor(F.col("at") / size).cast("long").alias("bucket"), F.lit(None).cast("long").alias("ref"))
    marks = turns.select("at", "bucket", F.col("at").alias("ref"))
    inside = Window.partitionBy("bucket").orderBy("at")
    seen = own.unionByName(marks).select("at", "bucket", "ref", F.last("ref", True).over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("below"), F.first("ref", True).over(inside.rangeBetween(0, Window.unboundedFollowing)).alias("above"))
    seen = seen.where("ref IS NULL").join(F.broadcast(grid), "bucket", "left")
    gap = F.least(F.col("at") - F.coalesce("below", "before"), F.coalesce("above", "after") - F.col("at")) - width
    found = seen.select("at", F.when(gap.isNotNull(), F.greatest(F.lit(0).cast("long"), gap)).alias("gap"))
    return asked.join(found, "at", "left").select("q", "gap")


def within_thresholds(df: DataFrame, gap: str, thresholds: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts of gaps up to each threshold, and of those beyond the last."""
    g = F.col(gap)
    aggs = [F.count_if(g <= t).alias(f"within_{t}") for t in thresholds]
    return df.groupBy(*(by or [])).agg(*aggs, F.count_if(g > thresholds[-1]).alias(f"beyond_{thresholds[-1]}"))


def dense(df: DataFrame, axes: list[DataFrame], on: list[str], value: str, fill: Column | None = None) -> DataFrame:
    """Every combination of the axes, with ``fill`` (0) where the table has no row."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    return grid.join(df, on, "left").withColumn(value, F.coalesce(value, F.lit(0) if fill is None else fill))
