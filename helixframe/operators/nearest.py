"""The exhaustive search of nearest neighbours inside one cell: a block of queries against a block of references.

A string is held as planes of bits, one word for 64 letters and each bit of a letter's code, so the
letters at which a pair differs are an exclusive or, and their number a count of bits.  Strings lie
in groups of near copies round a centre.  The centres of every two groups of a cell are measured; a pair
of strings is measured unless its groups are so far apart that, by the triangle inequality, it cannot
be among a query's k best.  Strings without near copies are their own centres, and so are all where
groups exclude too little; then every pair is measured.  What leaves the cell is what can still be among a query's k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixframe.functions.bases import PACKED

#: Queries and references of a cell at most (about), pairs that are worth a cell of their own, and groups of a tile that stays in the processor's cache.
QUERIES, REFERENCES, WORTH = 1 << 16, 1 << 18, 1 << 28
ROWS, PLACES = 16, 4096
#: Stretches of a block of references whose nearest ones bound the k-th best of all, at least.
STRETCHES = 64
#: Strings of a group at most, letters at which one may differ from the centre, and parts of a string, two of which are alike in a group.
GROUP, RADIUS, PARTS = 8, 4, 5
#: Pairs of strings that a tile measures at once, unless one group of queries has more.
PAIRS = 1 << 20
#: The share of pairs of strings that groups may leave to be measured, judged on so many tiles; a pair costs more there than in a tile.
SHARE, PROBES = 1 / 16, 4
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(PACKED.encode(), np.uint8)] = np.arange(len(PACKED))


def _letters(texts: pa.ChunkedArray, length: int) -> np.ndarray:
    """Codes of letters, a row a string."""
    if len(texts) and not pc.all(pc.equal(pc.utf8_length(texts), length)).as_py():
        raise ValueError(f"strings must have {length} letters")
    if not len(texts):
        return np.empty((0, length), np.uint8)
    held = pa.concat_arrays(texts.cast(pa.large_binary()).chunks)
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    codes = _CODES[np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    if (codes == 255).any():
        raise ValueError("no strings of bases")
    return codes.reshape(len(texts), length)


def _planes(codes: np.ndarray) -> list[list[np.ndarray]]:
    out = []
    for at in range(0, codes.shape[1], 64):
        part = np.zeros((len(codes), 64), np.uint8)
        own = codes[:, at : at + 64]
        part[:, : own.shape[1]] = own
        out.append([np.packbits(part >> b & 1, axis=1, bitorder="little").view("<u8").ravel() for b in range(4)])
    return out


def planes(texts: pa.ChunkedArray, length: int) -> list[list[np.ndarray]]:
    """Per word of 64 letters the four planes of bits, each a number a string."""
    return _planes(_letters(texts, length))


def grid(asked: int, held: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of references: no more cells than the bounds of a cell ask for, or than keep the cores busy, and of such grids one that sends the fewest rows."""
    across, down = max(1, -(-asked // QUERIES)), max(1, -(-held // REFERENCES))
    cells = -(-asked * held // WORTH)
    wanted = cells if cells <= cores else cores if cells < 3 * cores else 3 * cores
    grids = [(a, max(down, -(-wanted // a))) for a in range(across, max(across, wanted) + 1)]
    return min(grids, key=lambda g: (g[0] * held + g[1] * asked, g[0] * g[1]))


def parts(length: int) -> list[tuple[int, int]]:
    return [(i * length // PARTS, (i + 1) * length // PARTS) for i in range(PARTS)]


def _alike(codes: np.ndarray) -> np.ndarray:
    """A number a string, equal where two parts that follow each other are: the two with the fewest different contents."""
    factors = np.random.default_rng(0).integers(1, 1 << 63, codes.shape[1], dtype=np.uint64)
    sums = [codes[:, a:b].astype(np.uint64) @ factors[a:b] for a, b in parts(codes.shape[1])]
    return min((sums[i - 1] + sums[i] for i in range(PARTS)), key=lambda x: len(np.unique(x)))


class Side:
    """Strings as planes, group by group: ``order`` has their rows in the table, ``starts`` and ``sizes`` the groups, and no
    string of a group differs from its centre at more than ``radius`` letters."""

    def __init__(self, texts: pa.ChunkedArray, length: int, grouped: bool = True):
        codes = _letters(texts, length)
        count = len(codes)
        self.order, self.sizes, self.radius, centres = np.arange(count), np.ones(count, np.int64), np.zeros(count, np.int64), codes
        if grouped and count:
            alike = _alike(codes)
            order = np.argsort(alike, kind="stable")
            alike, own = alike[order], codes[order]
            firsts = np.flatnonzero(np.r_[True, alike[1:] != alike[:-1]])
            place = np.arange(count) - np.repeat(firsts, np.diff(firsts, append=count))
            heads = np.flatnonzero(place % GROUP == 0)
            sizes = np.diff(heads, append=count)
            group = np.repeat(np.arange(len(heads)), sizes)
            middle = np.zeros((len(heads), length), np.uint8)
            for b in range(4):
                bits = own >> b & 1
                if bits.any():
                    middle |= (2 * np.add.reduceat(bits, heads, axis=0, dtype=np.uint8) > sizes[:, None]).astype(np.uint8) << np.uint8(b)
            off = np.count_nonzero(own != middle[group], axis=1)
            alone = off > RADIUS
            label = np.where(alone, len(heads) + np.arange(count), group)
            again = np.argsort(label, kind="stable")
            heads = np.flatnonzero(np.r_[True, label[again][1:] != label[again][:-1]])
            if len(heads) <= 0.8 * count:
                self.order, self.sizes = order[again], np.diff(heads, append=count)
                self.radius = np.maximum.reduceat(np.where(alone, 0, off)[again], heads)
                codes, first = own[again], again[heads]
                centres = np.where(alone[first][:, None], own[first], middle[group[first]])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.strings, self.centres = _planes(codes), _planes(centres)


class Cell:
    """Distances and scores between a block of queries and one of references."""

    def __init__(self, asked: Side, held: Side, length: int, weights: list[float] | None):
        self.asked, self.held = asked, held
        # The planes that are not nought on both sides; the first stays.
        bits = [[b for b in range(4) if b == 0 or a[b].any() or h[b].any()] for a, h in zip(asked.strings, held.strings, strict=True)]
        self.strings, self.centres = ([[(a[b], h[b]) for b in own] for own, a, h in zip(bits, *sides, strict=True)] for sides in ((asked.strings, held.strings), (asked.centres, held.centres)))
        self.length, self.known = length, len(held.starts)
        width = -(-max(1, self.known) // STRETCHES)
        self.small = np.uint8 if length < 255 else np.uint16
        self.distances = np.full((ROWS, width * STRETCHES), np.iinfo(self.small).max, self.small)
        self.buffers = [np.empty((ROWS, PLACES), np.uint64) for _ in range(2)]
        own = weights or [1.0] * length
        self.classes = [(w, sum(v == w for v in own), self._masks([p for p in range(length) if own[p] == w])) for w in sorted(set(own))]
        self.plain = weights is None
        #: The greatest score at each distance.
        self.caps = np.append(np.cumsum(sorted(own, reverse=True))[::-1], 0.0)

    def _masks(self, places: list[int]) -> list[np.uint64]:
        return [np.uint64(sum(1 << p - at for p in places if at <= p < at + 64)) for at in range(0, self.length, 64)]

    def measure(self, start: int, stop: int) -> np.ndarray:
        """Distances of the centres of queries from ``start`` to ``stop`` to those of all references; columns past the last one hold the greatest number."""
        out = self.distances[: stop - start]
        for at in range(0, self.known, PLACES):
            upto = min(at + PLACES, self.known)
            x, y = (b[: stop - start, : upto - at] for b in self.buffers)
            for w, sides in enumerate(self.centres):
                for b, (a, h) in enumerate(sides):
                    np.bitwise_xor(a[start:stop, None], h[None, at:upto], out=y if b else x)
                    if b:
                        np.bitwise_or(x, y, out=x)
                if w == 0:
                    np.bitwise_count(x, out=out[:, at:upto], casting="unsafe")
                else:
                    out[:, at:upto] += np.bitwise_count(x)
        return out

    def pairs(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of strings of pairs of groups."""
        wide = self.held.sizes[columns]
        each = self.asked.sizes[rows] * wide
        ends = np.cumsum(each)
        down, across = np.divmod(np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each), np.repeat(wide, each))
        return np.repeat(self.asked.starts[rows], each) + down, np.repeat(self.held.starts[columns], each) + across

    def score(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Summed weights of the letters at which pairs of strings agree."""
        differs = []
        for sides in self.strings:
            d = sides[0][0][rows] ^ sides[0][1][columns]
            for a, h in sides[1:]:
                d |= a[rows] ^ h[columns]
            differs.append(d)
        if self.plain:
            return float(self.length) - sum(np.bitwise_count(d).astype(np.int64) for d in differs)
        out = np.zeros(len(rows))
        for weight, places, masks in self.classes:
            off = sum(np.bitwise_count(d & m).astype(np.int64) for d, m in zip(differs, masks, strict=True))
            out += weight * (places - off)
        return out

    def reach(self, d: np.ndarray, start: int, k: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Per group of queries the greatest distance to its centre of a string among the k best of one of its queries, or within
        the tolerance; per query a score that those reach.

        The nearest group of each stretch is found, and the strings of the nearest of those give a bound
        of the k-th best score; the weights give one of the distance that a pair of that score can have.
        """
        count, width = d.shape
        near = d.reshape(count, STRETCHES, -1).argmin(axis=2) + np.arange(STRETCHES) * (width // STRETCHES)
        few = min(STRETCHES, k if self.plain else max(k, 16))
        if few < STRETCHES:
            near = np.take_along_axis(near, np.argpartition(np.take_along_axis(d, near, axis=1), few - 1, axis=1)[:, :few], axis=1)
        there = near.ravel() < self.known
        rows, columns = self.pairs(np.repeat(start + np.arange(count), few)[there], near.ravel()[there])
        scores = self.score(rows, columns)
        order = np.lexsort((-scores, rows))
        first = self.asked.starts[start]
        heads = self.asked.starts[start : start + count] - first
        found = np.bincount(rows - first)
        edge = np.where(found >= k, scores[order][np.cumsum(found) - found + np.minimum(k, found) - 1], -np.inf)
        within = self.caps[None, :] >= (edge - tolerance - 1e-9)[:, None]
        far = self.length - within[:, ::-1].argmax(axis=1)
        return np.maximum.reduceat(far, heads) + self.asked.radius[start : start + count], edge - tolerance - 1e-9

    def best(self, start: int, stop: int, k: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, column, score, place)`` of all pairs whose score is the query's k-th best less the tolerance, or better, of the groups from ``start`` to ``stop``.

        Pairs are ordered by query, falling score and the reference's row in its table; ``place`` counts from 0 in each query.
        """
        d = self.measure(start, stop)
        queries = np.arange(self.asked.starts[start], self.asked.starts[stop - 1] + self.asked.sizes[stop - 1])
        far, least = np.full(stop - start, self.length), np.full(len(queries), -np.inf)
        if k <= STRETCHES:
            far, least = self.reach(d, start, k, tolerance)
        most = np.minimum(far + self.held.radius.max(), self.length)
        rows, columns = np.divmod(np.flatnonzero(d <= most.astype(self.small)[:, None]), d.shape[1])
        inside = d[rows, columns] <= far[rows] + self.held.radius[columns]
        rows, columns = start + rows[inside], columns[inside]
        left = (self.asked.sizes[rows] * self.held.sizes[columns]).sum()
        self.share = left / (len(queries) * len(self.held.order))
        if stop - start > 1 and left > PAIRS:
            return tuple(np.concatenate(x) for x in zip(*(self.best(i, i + 1, k, tolerance) for i in range(start, stop)), strict=True))
        rows, columns = self.pairs(rows, columns)
        scores = self.score(rows, columns)
        inside = scores >= least[rows - queries[0]]
        rows, columns, scores = rows[inside], columns[inside], scores[inside]
        order = np.lexsort((self.held.order[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        firsts = np.searchsorted(rows, queries)
        places = np.arange(len(rows)) - firsts[rows - queries[0]]
        lasts = np.searchsorted(rows, queries, "right") - 1
        edge = scores[np.minimum(firsts + k - 1, lasts)]
        keep = scores >= edge[rows - queries[0]] - tolerance
        return rows[keep], columns[keep], scores[keep], places[keep]

    def worth(self, k: int, tolerance: float) -> bool:
        """Whether groups exclude enough pairs, by tiles here and there."""
        groups = len(self.asked.starts)
        if not groups or not self.known or len(self.asked.order) + len(self.held.order) == groups + self.known:
            return True
        shares = []
        for start in range(0, groups, max(1, groups // PROBES)):
            self.best(start, start + 1, k, tolerance)
            shares.append(self.share)
        return sum(shares) <= SHARE * len(shares)

    def all_best(self, k: int, tolerance: float):
        """`best` of all queries, tile by tile, with rows and columns of the tables."""
        groups = len(self.asked.starts)
        for start in range(0, groups if self.known else 0, ROWS):
            rows, columns, scores, places = self.best(start, min(start + ROWS, groups), k, tolerance)
            yield self.asked.order[rows], self.held.order[columns], scores, places


def _cell(left: pa.Table, right: pa.Table, length: int, weights: list[float] | None, k: int, tolerance: float) -> Cell:
    cell = Cell(*(Side(side["text"], length) for side in (left, right)), length, weights)
    if cell.worth(k, tolerance):
        return cell
    return Cell(*(Side(side["text"], length, False) for side in (left, right)), length, weights)


def _pairs(chunks: list, kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([c[i] for c in chunks]) if chunks else np.empty(0, kind) for i, kind in enumerate(kinds)]


def closest_rows(k: int, length: int):
    """Cell function: ``(q, r, label, score)``, the k best references of each query, ties to the lowest reference."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("r")
        cell = _cell(left, right, length, None, k, 0.0)
        chunks = [tuple(c[kept] for c in (rows, columns, scores)) for rows, columns, scores, places in cell.all_best(k, 0.0) for kept in [places < k]]
        rows, columns, scores = _pairs(chunks, (np.int64, np.int64, np.float64))
        return pa.table({"q": left["q"].take(rows), "r": right["r"].take(columns), "label": right["label"].take(columns), "score": scores})

    return run


def closest_levels(k: int, weights: list[float] | None, tolerance: float, length: int):
    """Cell function: ``(q, score, n, known, labels)``, references by score of each query, down to its k-th best less the tolerance."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = _cell(left, right, length, weights, k, tolerance)
        held = [right[c].to_numpy() for c in ("n", "known", "labels")]
        chunks = []
        for rows, columns, scores, _ in cell.all_best(k, tolerance):
            starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (scores[1:] != scores[:-1])])
            chunks.append((rows[starts], scores[starts], *(np.add.reduceat(h[columns], starts) for h in held)))
        rows, scores, n, known, labels = _pairs(chunks, (np.int64, np.float64, np.int64, np.int64, np.float64))
        return pa.table({"q": left["q"].take(rows), "score": scores, "n": n, "known": known, "labels": labels})

    return run
