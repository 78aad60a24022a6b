"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (as 64-bit hashes), a MinHash
   signature and the keys of its signature bands.  Texts with equal sets form a class;
   only the smallest id of a class goes on.
2. Classes that share a band key are candidates.  Within a key, members are compared to
   one centre, not to each other: first the smallest id, then - where members are still
   in different components - the member with the most links so far.  What is still
   unconnected after that is compared pairwise, across components only.  Every candidate
   pair is either verified or already connected, so no component is lost.
3. A pair's signatures are compared batch by batch.  After each batch the posterior
   probability (uniform prior) that the similarity reaches the threshold decides whether
   the pair goes on; the chance to drop a true pair is ``MISS`` a batch at most.
4. Survivors are verified on their full shingle sets.  Only verified links count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import WordHasher, components, discard, map_batches, materialize, mixed, parted, rolling, texts_of
from helixframe.shipping import arrow_map

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, BAND_ROWS, BATCH, MISS = 32, 6, 16, 1e-6
#: Members up to which a key is compared pair by pair, and members of a block beyond that.
FEW, BLOCK = 48, 256
_PRIME = 0x9E3779B97F4A7C15


@cache
def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240917).integers(0, 2**32, size=count, dtype=np.uint32) | np.uint32(1)


@cache
def least_matches(threshold: float, hashes: int = BANDS * BAND_ROWS, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """For each batch end, the fewest matches at which P(similarity >= threshold) >= miss.

    With a uniform prior, m matches of n give a Beta(m + 1, n - m + 1) posterior, whose
    upper tail is the binomial probability of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                out.append(m)
                break
    return tuple(out)


def shingle_hashes(text: str, hasher: WordHasher, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, ASCII lower-cased.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; a text
    without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    at = hasher.ids(words)
    values = hasher.low[at]
    hashed = rolling(values, min(size, len(values)), _PRIME)
    return np.unique(mixed(hashed + np.uint64(len(words) if len(words) < size else 0)))


def signature(shingles: np.ndarray, hashes: int = BANDS * BAND_ROWS) -> np.ndarray:
    """MinHash signature: for each multiplier the least of its products, mod 2**32."""
    short, by = (shingles >> np.uint64(32)).astype(np.uint32), _multipliers(hashes)[:, None]
    out = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(short), 2048):
        out = np.minimum(out, (by * short[None, i : i + 2048]).min(axis=1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_PRIME)
    for i in range(BAND_ROWS):
        key = mixed(key ^ rows[:, i]) * np.uint64(_PRIME | 1)
    return mixed(key).view(np.int64)


def _features(size: int):
    def make():
        hasher = WordHasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, d1, d2, bands = [], [], [], []
            for text in texts_of(batch.column("text")):
                s = shingle_hashes(text, hasher, size)
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append((both & 0xFFFFFFFFFFFFFFFF) - 2**63)
                d2.append((both >> 64) - 2**63)
                bands.append(band_keys(signature(s)) if len(s) else np.empty(0, dtype=np.int64))
            ends = np.cumsum([0, *(len(b) for b in bands)])
            flat = np.concatenate(bands) if bands else np.empty(0, dtype=np.int64)
            arrays = [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "mark", "n_shingles", "d1", "d2", "bands"])

        return step

    return make


def _sets(size: int):
    def make():
        hasher = WordHasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sigs, bands, sets = [], [], []
            for text in texts_of(batch.column("text")):
                s = shingle_hashes(text, hasher, size)
                sig = signature(s)
                sets.append(s.tobytes())
                bands.append(band_keys(sig).tobytes())
                sigs.append(sig.astype(np.uint16).tobytes())
            binary = pa.binary()
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, binary), pa.array(bands, binary), pa.array(sets, binary)], names=["id", "sig", "bands", "shingles"])

        return step

    return make


def likely(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test: a boolean a row."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, at] == right[alive, at]).sum(axis=1)
        go = matches >= least
        alive, matches = alive[go], matches[go]
        if not len(alive):
            break
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            go = pa.array(likely(left, right, percent / 100))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(go), batch.column("b").filter(go)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = np.intersect1d(u, v, assume_unique=True).size
                linked.append(100 * both >= percent * (len(u) + len(v) - both))
            go = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(go), batch.column("b").filter(go)], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough."""
    sig = pool.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    alive = materialize(arrow_map(both, _prune(percent), "a long, b long"), "survivors")
    sets = pool.select("id", "shingles")
    full = alive.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a").select("a", "b", "xa", "xb")
    links = materialize(arrow_map(full, _exact(percent), "a long, b long"), "links")
    discard(alive)
    return links


def _block_links(percent: int):
    """applyInArrow function: the links that join components, of one block or between two of a key.

    A pair that shares several keys is compared under the first of its bands only.
    """

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, groups = table.column("id").to_numpy(), table.column("group").to_numpy()
        matrix = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind).reshape(len(ids), -1)
        sig, bands = matrix("sig", np.uint16), matrix("bands", np.int64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        root = {g: g for g in groups.tolist()}

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        band = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        right = left if alone else right
        found = []
        for start in range(0, len(left), 64):
            rows = left[start : start + 64]
            meet = groups[rows][:, None] != groups[right][None, :]
            for k in range(band):
                meet &= bands[rows, k][:, None] != bands[right, k][None, :]
            if alone:
                meet &= ids[rows][:, None] < ids[right][None, :]
            i, j = np.nonzero(meet)
            go = likely(sig[rows[i]], sig[right[j]], percent / 100)
            i, j = rows[i[go]], right[j[go]]
            for x in np.unique(i):
                mine = find(int(groups[x]))
                others = [y for y in j[i == x].tolist() if find(int(groups[y])) != mine]
                if not others:
                    continue
                flat, own = np.concatenate([sets[y] for y in others]), sets[x]
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                ends = np.cumsum([len(sets[y]) for y in others])
                both = np.diff(np.concatenate([[0], np.cumsum(own[at] == flat)[ends - 1]]))
                for y, n in zip(others, both.tolist(), strict=True):
                    if 100 * n >= percent * (len(own) + len(sets[y]) - n):
                        g, h = find(int(groups[x])), find(int(groups[y]))
                        if g != h:
                            root[max(g, h)] = min(g, h)
                            found.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _block_verify(many: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of large keys, ``(key, id, group)``.

    The members of a key are cut into blocks: large components into blocks of their own,
    the others into shared ones.  Every two blocks of a key meet in one task, but for blocks
    of the same component; a task holds two blocks.  A pair whose first shared band is not a
    large key is compared where that key is, or connected already.
    """
    groups = many.groupBy("key", "group").agg(F.count("*").alias("n"))
    rest = groups.where(F.col("n") <= BLOCK // 2).groupBy("key").agg(F.sum("n").alias("rest"))
    groups = groups.join(rest, "key", "left")
    large = F.col("n") > BLOCK // 2
    count = F.ceil(F.when(large, F.col("n")).otherwise(F.col("rest")) / F.lit(float(BLOCK)))
    groups = groups.select("key", "group", F.when(large, F.col("group")).alias("whole"), count.alias("blocks"))
    number = F.pmod(F.xxhash64(F.when(F.col("whole").isNull(), F.col("group")).otherwise(F.col("id"))), F.col("blocks"))
    placed = materialize(many.join(groups, ["key", "group"]).select("key", "id", "group", "whole", F.concat_ws("/", F.coalesce(F.col("whole").cast("string"), F.lit("")), number.cast("string")).alias("block")), "placed")

    blocks = placed.select("key", "whole", "block").distinct()
    pairs = blocks.join(blocks.toDF("key", "whole2", "block2"), "key").where("block <= block2 AND (whole IS NULL OR whole2 IS NULL OR whole <> whole2)")
    pairs = pairs.select("key", "block", "block2", F.xxhash64("key", "block", "block2").alias("pair"))
    left = placed.join(pairs, ["key", "block"]).select("pair", "key", F.lit(0).alias("side"), "id", "group")
    right = placed.join(pairs.where("block < block2").select("key", F.col("block2").alias("block"), "pair"), ["key", "block"]).select("pair", "key", F.lit(1).alias("side"), "id", "group")
    full = left.unionByName(right).join(pool, "id").select("pair", "key", "side", "id", "group", "sig", "bands", "shingles")
    links = materialize(full.groupBy("pair").applyInArrow(_block_links(percent), "a long, b long"), "links")
    discard(placed)
    return links


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row; see `grouped` for odd rows."""
    out = grouped(docs, shingle_words, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of smallest doc_id, then of least text hash.

    Rows without an id can't be linked and stay, and so do texts without words.  Of rows equal in
    id and text one stays.  Only texts whose ids lose a row are looked up, not shuffled as a whole.
    """
    found = grouped(docs, shingle_words, percent).where("doc_id IS NOT NULL AND component IS NOT NULL")
    rows = materialize(found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n")), "grouped")
    least = rows.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.sum("n").alias("all")).where(F.col("all") > 1)
    apart = rows.join(least, "component").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), (F.struct("doc_id", "mark") == F.col("least")).alias("_stays"), F.col("n").alias("_n"))
    touched = materialize(apart.where("NOT _stays OR _n > 1"), "touched")
    discard(rows)
    key = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_mark", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    hit, rest = parted(key, "_id", touched)
    gone = hit.join(touched.select("_id", "_mark"), ["_id", "_mark"], "left_anti").select(*docs.columns)
    again = hit.join(touched.where("_stays").select("_id", "_mark"), ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select(*docs.columns)
    return rest.select(*docs.columns).unionByName(gone).unionByName(again)


def grouped(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, mark, n_shingles, component, component_id)`` for every row.

    ``mark`` is the hash of the text, ``component`` names the component, ``component_id`` is
    its smallest doc_id.  Reads ``doc_id`` and ``text``; other columns are ignored.  A null or
    empty text has no shingles, is linked with nothing and has no component.  Rows that share
    an id are documents of their own, each linked by its own text.  A row without an id can't
    be linked: its component_id is null unless a row with an id has the same set.  Repeated
    rows each return.  An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    feats = materialize(map_batches(rows, _features(shingle_words), "doc_id long, mark long, n_shingles long, d1 long, d2 long, bands array<long>"), "shingles")

    # One row stands for a class.  Nodes are numbered in the order of the smallest ids, so that the smallest node of a component has its smallest id.
    first = feats.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    ordered = first.select("d1", "d2", "first.doc_id", "first.mark").repartitionByRange("doc_id", "d1", "d2").sortWithinPartitions("doc_id", "d1", "d2")
    classes = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "classes")
    own = feats.select("doc_id", "mark", "d1", "d2", "bands").join(classes, ["doc_id", "mark", "d1", "d2"]).dropDuplicates(["doc_id", "mark", "d1", "d2"])
    keyed = materialize(own.select("id", F.explode("bands").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last")
    members = materialize(keyed.join(shared.select("key", "centre"), "key"), "members")
    discard(keyed)

    ids = materialize(classes.join(members.select("id").distinct(), "id").select("id", "doc_id", "mark"), "ids")
    chosen = parted(rows, "doc_id", ids)[0].join(ids, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    pool = materialize(map_batches(chosen.select("id", "text"), _sets(shingle_words), "id long, sig binary, bands binary, shingles binary"), "pool")
    discard(ids)

    # Round 1: every member against the smallest id under its key.
    tested_first = tested = materialize(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "tested")
    links = _verify(tested, pool, percent)
    groups = components(links)

    # Round 2: keys whose members are still apart, against the member with the most links.
    apart = _apart(members, groups)
    if not apart.isEmpty():
        degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
        ranked = apart.join(degree, "id", "left").select("key", "id", "group", F.coalesce("links", F.lit(0)).alias("links"))
        hubs = ranked.groupBy("key").agg(F.max(F.struct("links", (-F.col("id")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("hub"))
        pairs = apart.join(hubs, "key").join(apart.select("key", F.col("id").alias("hub"), F.col("group").alias("hub_group")), ["key", "hub"])
        pairs = pairs.where("group <> hub_group").select(*_ordered("id", "hub")).distinct().join(tested, ["a", "b"], "left_anti")
        fresh = materialize(pairs, "tested")
        links = links.unionByName(_verify(fresh, pool, percent))
        tested = tested.unionByName(fresh)
        groups = components(links)

        # Round 3: what is left, across components only.
        apart = _apart(members, groups)
        if not apart.isEmpty():
            sizes = apart.groupBy("key").agg(F.count("*").alias("n"))
            few = apart.join(sizes.where(F.col("n") <= FEW).select("key"), "key")
            other = few.toDF("key", "id2", "group2")
            pairs = few.join(other, "key").where("id < id2 AND group <> group2").select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
            fresh = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "tested")
            links = links.unionByName(_verify(fresh, pool, percent))
            many = materialize(apart.join(sizes.where(F.col("n") > FEW).select("key"), "key"), "many")
            if not many.isEmpty():
                links = links.unionByName(_block_verify(many, pool, percent))
            groups = components(links)

    least = classes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
    named = classes.join(groups, "id", "left").select("d1", "d2", F.coalesce("component_id", "id").alias("component")).join(least, "component")
    named = materialize(named, "names")
    discard(members, pool, tested_first, classes)  # what is left to read is small: one row a document or class
    out = feats.select("doc_id", "mark", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select("doc_id", "mark", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``(key, id, group)`` of the keys whose members lie in more than one component."""
    named = members.join(groups, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("group"))
    mixed_keys = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    return materialize(named.join(mixed_keys, "key"), "apart")
