"""Components, clusters and the assignment of clusters to parts.

Components run as rounds of contraction on DataFrames, each ended by a checkpoint.
Assigning clusters to splits and folds is sequential by nature and works on the table of
cluster sizes, on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.joins import sorted_join
from helixframe.session import checkpoint


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every node in ``nodes(id)`` under ``edges(i, j)``; root is the smallest id reachable.

    Every round each node moves to the best of itself and its neighbours - by id first,
    by a fresh hash later, so that chains shrink by a constant factor - and edges are renamed.
    """
    left = checkpoint(edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a < b").distinct())
    names = nodes.select("id", F.col("id").alias("root")).distinct()
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("n"))) if turn == 0 else (lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("n")))
        step = checkpoint(both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a")).getField("n").alias("to")))
        names = checkpoint(sorted_join(names, step, names["root"] == step["a"], "left").select("id", F.coalesce("to", "root").alias("root")))
        moved = sorted_join(sorted_join(left, step.toDF("a", "x"), "a"), step.toDF("b", "y"), "b").where("x <> y")
        left = checkpoint(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    least = names.groupBy("root").agg(F.min("id").alias("least"))
    return sorted_join(names, least, "root").select("id", F.col("least").alias("root"))


def canonical_labels(components: DataFrame) -> DataFrame:
    """Adds ``label``: 0, 1, ... in order of each component's smallest id.

    Ranks are taken over the roots alone, in two levels (ranges of roots, then inside), so
    that no task sees all of them.
    """
    roots = components.where("id = root").select("root")
    spread = roots.agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    dealt = roots.crossJoin(F.broadcast(spread)).select("root", F.least(F.lit(1023), F.floor((F.col("root") - F.col("lo")) * 1024 / (F.col("hi") - F.col("lo") + 1))).cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("root")) - 1).join(F.broadcast(starts), "range")
    return sorted_join(components, ranked.select("root", (F.col("start") + F.col("k")).alias("label")), "root").select("id", "root", "label")


def cluster_summary(components: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, clusters, largest, singletons, forest edges (nodes less clusters) and pair edges."""
    sizes = components.groupBy("root").agg(F.count("*").alias("n"))
    pairs = edges.agg(F.count("*").alias("pair_edges"))
    whole = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
    return whole.crossJoin(pairs).select("nodes", "clusters", "largest", "singletons", (F.col("nodes") - F.col("clusters")).alias("forest_edges"), "pair_edges")


def greedy_split(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Cluster to split: largest first, each where the squared relative misses of all splits come out least.

    ``sizes`` holds (cluster, rows).  Ties go to the split with fewer rows, then to the earlier one.
    """
    total = sum(n for _, n in sizes)
    names = list(shares)
    target = np.array([shares[s] * total for s in names])
    filled, out = np.zeros(len(names)), {}
    for cluster, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        trial = filled[None, :] + np.eye(len(names)) * n
        cost = (((trial - target) / target) ** 2).sum(axis=1)
        k = min(range(len(names)), key=lambda i: (round(float(cost[i]), 12), filled[i], i))
        filled[k] += n
        out[cluster] = names[k]
    return out


def greedy_folds(sizes: list[tuple[int, int]], folds: int, seed: int) -> dict[int, int]:
    """Cluster to fold: shuffled by seed, largest first, each into the fold with fewest rows."""
    order = np.random.default_rng(seed).permutation(len(sizes))
    ranked = sorted((sizes[i] for i in order), key=lambda x: -x[1])
    filled, out = [0] * folds, {}
    for cluster, n in ranked:
        k = filled.index(min(filled))
        filled[k] += n
        out[cluster] = k
    return out


def nested_folds(sizes: list[tuple[int, int]], outer: int, inner: int, seed: int) -> list[dict]:
    """Outer folds, each with inner folds of its training clusters (seed + 10 + k), and final ones over all (seed + 99)."""
    first = greedy_folds(sizes, outer, seed)
    out = []
    for k in range(outer):
        rest = [(c, n) for c, n in sizes if first[c] != k]
        out.append({"held_out": [c for c, _ in sizes if first[c] == k], "inner": greedy_folds(rest, inner, seed + 10 + k)})
    return [*out, {"held_out": [], "inner": greedy_folds(sizes, inner, seed + 99)}]


def stratified_group_folds(rows: list[tuple[int, int, int]], folds: int, seed: int | None = None) -> dict[int, int]:
    """Cluster to fold with even label shares; ``rows`` holds (cluster, positives, negatives).

    Clusters with the most uneven counts come first, equally uneven ones in the order given, or
    shuffled where there is a seed.  Each goes where the shares of both labels spread least
    over the folds, and among equals where there are fewest rows.
    """
    order = np.arange(len(rows)) if seed is None else np.random.RandomState(seed).permutation(len(rows))
    table = np.array([rows[i][1:] for i in order], dtype=float).reshape(-1, 2)
    total = np.maximum(1, table.sum(axis=0))
    counts, out = np.zeros((folds, 2)), {}
    for k in np.argsort(-table.std(axis=1), kind="stable"):
        tried = counts[None, :, :] + np.eye(folds)[:, :, None] * table[k]
        spread = (tried / total).std(axis=1).mean(axis=1)
        close = np.flatnonzero(np.isclose(spread, spread.min()))
        best = close[counts[close].sum(axis=1).argmin()]
        counts[best] += table[k]
        out[rows[order[k]][0]] = int(best)
    return out


def holdout_and_folds(rows: list[tuple[int, int, int]], outer: int, inner: int, seed: int) -> dict[int, str]:
    """Cluster to part: the first of ``outer`` stratified folds is the test, the first of ``inner`` over the rest the validation."""
    first = stratified_group_folds(rows, outer, seed)
    second = stratified_group_folds([r for r in rows if first[r[0]] != 0], inner, seed)
    return {c: "test" if f == 0 else "validation" if second[c] == 0 else "train" for c, f in first.items()}


def hashed_split(df: DataFrame, key: str, shares: tuple[float, float], seed: int, buckets: int = 256) -> DataFrame:
    """Rows dealt to train, validation and test in hash order: the first ``int(n * share)`` rows and so on; the rest is test.

    Positions in the order are found by bucket counts and ranks inside a bucket.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))
    dealt = df.select(key, h.alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) - 1).join(F.broadcast(starts), "bucket")
    place, total = F.col("start") + F.col("k"), F.col("total")
    first, second = F.floor(total * F.lit(shares[0])), F.floor(total * F.lit(shares[1]))
    return ranked.select(key, F.when(place < first, "train").when(place < first + second, "validation").otherwise("test").alias("split"))
