"""Near-duplicate vectors by E8 lattice hashing.

Each of ``TABLES`` tables projects a unit vector by a random Gaussian matrix to two
blocks of eight coordinates, scales and shifts them, and decodes each block to the
nearest point of the E8 lattice; the two points name the cell.  A vector is stored
under its own cell and looks into the ``PROBES`` nearest cells (its own and those whose
lattice points differ by minimal vectors, nearest sums first).  Vectors that meet are
compared by cosine in double precision; only those at the threshold or above are links.

The number of vectors chooses the design (`design_for`): more blocks and finer cells for
more vectors, and as many tables as a pair at cosine 0.9 needs to meet with probability
0.93 under each design; one at 0.95 meets with 0.999.  Unrelated pairs meet with the
probability `chance`, so that their candidates a vector stay few at every size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import components, discard, materialize, mixed
from helixframe.shipping import arrow_map

PROBES, THRESHOLD = 8, 0.9
#: Neighbours of a block's cell among which the nearest cells are sought.
NEAR = 7


class Design(NamedTuple):
    """Tables, E8 blocks a table and the scale of projections."""

    tables: int
    blocks: int
    scale: float

    def chance(self, probes: int) -> float:
        """Probability that unrelated vectors meet: the density of the difference of two Gaussian points, a cell's volume being 1."""
        return min(1.0, 2 * self.tables * probes * (self.scale**2 / (4 * math.pi)) ** (4 * self.blocks))


#: Designs of equal recall, from coarse to fine.
DESIGNS = (Design(13, 2, 1.6), Design(25, 2, 1.4), Design(32, 3, 1.8), Design(64, 3, 1.6), Design(122, 4, 1.8), Design(324, 4, 1.6), Design(1042, 4, 1.4))
#: Cost of comparing a candidate pair, in stored keys.
PAIR_COST = 8


def design_for(vectors: int, probes: int = PROBES) -> Design:
    """The design that costs least over this many vectors: keys a vector, and comparisons with unrelated ones."""
    return min(DESIGNS, key=lambda d: d.tables * (1 + probes) + vectors * d.chance(probes) * PAIR_COST)


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 with an even number of minus signs."""
    pairs = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array([*pairs, *halves], dtype=np.float64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, then move the worst coordinate if the sum is odd."""
    f = np.rint(x)
    error = x - f
    odd = np.flatnonzero(f.sum(axis=-1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=-1)
    f[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points of rows of eight coordinates: E8 is D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


@cache
def _projection(dim: int, tables: int, blocks: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, tables, 51])
    return rng.normal(size=(dim, tables * blocks * 8)) / scale, rng.uniform(0, 2, size=tables * blocks * 8)


@cache
def _cell_multipliers(blocks: int) -> np.ndarray:
    return np.random.default_rng(8).integers(0, 2**63, size=(blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _block_hash(points: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Sums of doubled coordinates times odd multipliers, mod 2**64; hashes of blocks add up."""
    return ((points * 2).astype(np.int64).view(np.uint64) * multipliers).sum(axis=-1, dtype=np.uint64)


def _cheapest(keys: np.ndarray, cost: np.ndarray, more: np.ndarray, extra: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` cheapest sums of one key of either side, cheapest first; the sum of both first keys is the first."""
    both = (cost[:, :, None] + extra[:, None, :]).reshape(len(cost), -1)
    best = np.argsort(both, axis=1, kind="stable")[:, :count]
    sums = (keys[:, :, None] + more[:, None, :]).reshape(len(keys), -1)
    return np.take_along_axis(sums, best, axis=1), np.take_along_axis(both, best, axis=1)


def cells(vectors: np.ndarray, probes: int, design: Design) -> np.ndarray:
    """For unit vectors the keys of their ``probes`` nearest cells in every table: (vectors, tables, probes); the own cell is first."""
    n, dim = vectors.shape
    tables, blocks = design.tables, design.blocks
    matrix, shift = _projection(dim, tables, blocks, design.scale)
    y = (vectors @ matrix + shift).reshape(n * tables, blocks, 8)
    table = np.tile(np.arange(tables, dtype=np.uint64), n)
    salt = mixed(table * np.uint64(1000003) + np.uint64(dim * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    roots = minimal_vectors()
    out, cost = np.zeros((len(y), 1), dtype=np.uint64), np.zeros((len(y), 1))
    for b in range(blocks):
        home, multipliers = nearest_e8(y[:, b]), _cell_multipliers(blocks)[b]
        own = _block_hash(home, multipliers)[:, None]
        if probes == 1:
            out = out + own
            continue
        gain = (y[:, b] - home) @ roots.T
        near = np.argpartition(-gain, NEAR, axis=1)[:, :NEAR]
        keys = np.concatenate([own, own + _block_hash(roots, multipliers)[near]], axis=1)
        extra = np.concatenate([np.zeros((len(own), 1)), 2 - 2 * np.take_along_axis(gain, near, axis=1)], axis=1)
        out, cost = _cheapest(out, cost, keys, extra, probes)
    return mixed(out ^ salt[:, None]).view(np.int64).reshape(n, tables, probes)


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, or None where it can't have a cosine."""
    if not vector or any(x is None for x in vector):
        return None
    out = np.array(vector, dtype=np.float64)
    return out if np.isfinite(out).all() and out.any() else None


def _stacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrices of the vectors of a column, those of one length together."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(dim))


def _unit_range(x: np.ndarray) -> np.ndarray:
    """Rows over their largest component, so that no square over- or underflows."""
    return x / np.abs(x).max(axis=1)[:, None]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with 128-bit digests of usable vectors; vectors that can't be used have none."""
    for batch in batches:
        d1, d2 = [], []
        for v in batch.column("embedding").to_pylist():
            u = usable(v)
            both = None if u is None else xxhash.xxh3_128_intdigest((u + 0.0).tobytes())
            d1.append(None if both is None else (both & 0xFFFFFFFFFFFFFFFF) - 2**63)
            d2.append(None if both is None else (both >> 64) - 2**63)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), batch.column("embedding")], names=["vec_id", "d1", "d2", "embedding"])


def _keyed(probes: int, design: Design):
    """mapInArrow function: ``(cell, node)`` for the nearest ``probes`` cells of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at, matrix in _stacked(batch.column("embedding")):
                unit = _unit_range(matrix)
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                step = max(1, 20_000 // design.tables)
                for k in range(0, len(at), step):
                    found = cells(unit[k : k + step], probes, design).reshape(len(at[k : k + step]), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(nodes[at[k : k + step]], found.shape[1]))], names=["cell", "node"])

    return run


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision."""
    u, v = _unit_range(u), _unit_range(v)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(u, v) / np.sqrt(dot(u, u) * dot(v, v))


def cosine(u: np.ndarray, v: np.ndarray) -> float:
    return float(cosines(u[None, :], v[None, :])[0])


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pc.equal(pc.list_value_length(batch.column("xa")), pc.list_value_length(batch.column("xb")))
            batch = batch.filter(same)
            go = np.zeros(batch.num_rows, dtype=bool)
            for (at, u), (_, v) in zip(_stacked(batch.column("xa")), _stacked(batch.column("xb")), strict=True):
                go[at] = cosines(u, v) >= threshold
            keep = pa.array(go)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, design: Design | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Reads ``vec_id`` and ``embedding``; other columns are ignored.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link.  Equal vectors are one class: its members are linked with
    each other and with all members of a linked class, without pairs being written.  Rows
    that share an id are vectors of their own, each with its own links.  A row without an id
    has a null component unless its class has one with an id, and is not kept.  Without
    ``design`` the number of classes chooses one (see `design_for`).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    digests = materialize(arrow_map(rows, _digests, "vec_id long, d1 long, d2 long, embedding array<double>"), "vectors")
    found = materialize(digests.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")), "vector-groups")
    # Nodes are numbered in the order of the smallest ids, so that the smallest node of a component has its smallest id.
    ordered = found.where("id IS NOT NULL").repartitionByRange("id", "d1", "d2").sortWithinPartitions("id", "d1", "d2")
    classes = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    design = design or design_for(classes.count())

    own = digests.select("d1", "d2", F.col("vec_id").alias("id"), "embedding").join(classes.select("d1", "d2", "id", "node"), ["d1", "d2", "id"])
    pool = materialize(own.select("node", "embedding").dropDuplicates(["node"]), "vector-pool")

    home = arrow_map(pool, _keyed(1, design), "cell long, node long")
    seek = arrow_map(pool, _keyed(probes, design), "cell long, node long").withColumnRenamed("node", "other")
    met = home.join(seek, "cell").where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    both = met.join(pool.toDF("a", "xa"), "a").join(pool.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    links = materialize(arrow_map(both, _linked(threshold), "a long, b long"), "vector-links")

    sizes = classes.select(F.col("node").alias("b"), "size")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("outside")).withColumnRenamed("a", "node")
    groups = components(links).select(F.col("id").alias("node"), F.col("component_id").alias("root"))
    first = classes.select(F.col("node").alias("root"), F.col("id").alias("least"))
    named = classes.join(linked, "node", "left").join(groups.join(first, "root"), "node", "left")
    named = materialize(named.select("d1", "d2", F.coalesce("outside", F.lit(0)).alias("outside"), F.coalesce("least", "id").alias("least")), "vector-names")
    discard(classes, pool, links)
    out = digests.select("vec_id", "d1", "d2").join(found.select("d1", "d2", "size"), ["d1", "d2"], "left").join(named, ["d1", "d2"], "left")
    n_links = F.coalesce(F.col("size") - 1 + F.coalesce("outside", F.lit(0)), F.lit(0)).cast("long")
    out = out.select("vec_id", n_links.alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
