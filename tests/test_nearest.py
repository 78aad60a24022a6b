"""Exhaustive nearest neighbours against a direct search over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from helixframe.operators import joins, nearest

WEIGHTS = [1 + (i % 7) / 10 for i in range(50)]


def _texts(count, length, seed, letters="ACGT"):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, len(letters), length)
    out = []
    for _ in range(count):
        own = base.copy()
        for p in rng.integers(0, length, int(rng.integers(0, length))):
            own[p] = rng.integers(0, len(letters))
        out.append("".join(letters[c] for c in own))
    return out


def _score(a, b, weights):
    same = [p for p in range(len(a)) if a[p] == b[p]]
    return sum(weights[p] for p in same) if weights else float(len(same))


@pytest.mark.parametrize("length,letters,weights", [(50, "ACGT", None), (50, "ACGT", WEIGHTS), (130, "ACGTN-", None), (300, "ACGT", None), (1, "A", None)])
@pytest.mark.parametrize("k,held", [(1, 1), (1, 700), (10, 7), (10, 700), (100, 700)])
def test_cell_keeps_the_best(length, letters, weights, k, held):
    asked, refs = _texts(19, length, 1, letters), _texts(held, length, 2, letters)
    left = pa.table({"q": range(len(asked)), "text": asked})
    right = pa.table({"r": [7 * i for i in range(held)], "text": refs, "label": [float(i) for i in range(held)]})
    found = nearest.closest_rows(k, length)(left, right)
    levels = nearest.closest_levels(k, weights, 1e-10, length)(left, pa.table({"text": refs, "n": [1] * held, "known": [1] * held, "labels": right["label"]}))
    for q, text in enumerate(asked):
        wanted = sorted((-round(_score(text, t, weights), 9), 7 * i) for i, t in enumerate(refs))
        got = [(-round(s, 9), r) for x, r, s in zip(*(found[c].to_pylist() for c in ("q", "r", "score")), strict=True) if x == q]
        assert weights or sorted(got) == wanted[:k]
        edge = wanted[: k][-1][0]
        ties = [w for w in wanted if w[0] <= edge]
        sums = [(s, n, y) for x, s, n, y in zip(*(levels[c].to_pylist() for c in ("q", "score", "n", "labels")), strict=True) if x == q]
        assert sum(n for _, n, _ in sums) == len(ties) and {-round(s, 9) for s, _, _ in sums} == {w[0] for w in ties}
        assert sum(y for _, _, y in sums) == sum(r / 7 for _, r in ties)


def test_cell_refuses_other_strings():
    with pytest.raises(ValueError):
        nearest.planes(pa.chunked_array([["ACGT", "ACG"]]), 4)
    with pytest.raises(ValueError):
        nearest.planes(pa.chunked_array([["ACGx"]]), 4)


def test_blocks_agree_with_all_pairs(spark, monkeypatch):
    """Many blocks, copies on both sides and references without a label."""
    monkeypatch.setattr(nearest, "QUERIES", 5)
    monkeypatch.setattr(nearest, "REFERENCES", 40)
    refs = _texts(150, 50, 3)
    refs += refs[:60] + [refs[0]] * 25
    rows = [(i, t, None if i % 9 == 0 else float(i)) for i, t in enumerate(refs)]
    queries = spark.createDataFrame(list(enumerate([*_texts(11, 50, 4), refs[0], refs[0]])), "q long, text string")
    references = spark.createDataFrame(rows, "r long, text string, label double")
    scored = joins.match_counts(queries, references)
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(joins.nearest_mean(joins.closest_levels(queries, references, 1))) == plain(joins.nearest_mean(scored))
    assert plain(joins.nearest_k_fractional(joins.closest_levels(queries, references, 10), 10)) == plain(joins.nearest_k_fractional(scored, 10))
    assert plain(joins.nearest_k(joins.closest_rows(queries, references, 10), 10)) == plain(joins.nearest_k(scored, 10))
    first = [r[:3] for r in joins.nearest_first(joins.closest_rows(queries, references, 1)).collect()]
    assert sorted(first) == sorted(r[:3] for r in joins.nearest_first(scored).collect())
    weighted = joins.closest_levels(queries, references, 1, WEIGHTS, 1e-10)
    assert plain(joins.nearest_mean(weighted, 1e-10)) == plain(joins.nearest_mean(joins.match_counts(queries, references, WEIGHTS), 1e-10))


def test_labels_that_are_missing_are_left_out_of_means(spark):
    scored = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 2, None, 5.0), (2, 1, None, 3.0)], "q long, r long, label double, score double")
    assert {r["q"]: (r["ties"], r["prediction"]) for r in joins.nearest_mean(scored).collect()} == {1: (2, 2.0), 2: (1, None)}


def test_a_pair_costs_no_row(spark):
    """All pairs stay inside a task: the plan has no product of queries and references."""
    queries = spark.createDataFrame(list(enumerate(_texts(5, 50, 5))), "q long, text string")
    references = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(_texts(20, 50, 6))], "r long, text string, label double")
    for found in (joins.closest_levels(queries, references, 1), joins.closest_rows(queries, references, 1)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _families(count, length, seed, fixed=0):
    """Families of five round random strings; strings agree on the first ``fixed`` letters."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 4, (count // 5 + 1, length)).repeat(5, axis=0)[:count]
    base[np.arange(count), np.arange(count) % 5 * (length // 10)] += 1
    base[:, :fixed] = 0
    return ["".join("ACGT"[c % 4] for c in row) for row in base]


@pytest.mark.parametrize("k,weights", [(1, None), (10, None), (1, WEIGHTS), (70, None)])
def test_near_copies_are_measured_by_their_centres(k, weights):
    """Few pairs of strings are measured, and the best are those of a direct search."""
    asked, refs = _families(60, 50, 1), _families(2000, 50, 2)
    order = np.random.default_rng(3).permutation(len(refs))
    refs = [refs[i] for i in order]
    sides = [nearest.Side(pa.chunked_array([texts]), 50) for texts in (asked, refs)]
    assert [len(s.starts) for s in sides] == [12, 400] and max(s.radius.max() for s in sides) <= 2
    cell, shares = nearest.Cell(*sides, 50, weights), []
    for i in range(12):
        cell.best(i, i + 1, k, 1e-10)
        shares.append(cell.share)
    assert k > nearest.STRETCHES or (max(shares) < 0.5 and sum(shares) / 12 < 0.2)
    left = pa.table({"q": range(60), "text": asked})
    labels = [float(i) for i in range(len(refs))]
    levels = nearest.closest_levels(k, weights, 1e-10, 50)(left, pa.table({"text": refs, "n": [1] * 2000, "known": [1] * 2000, "labels": labels}))
    for q, text in enumerate(asked):
        scores = [round(_score(text, t, weights), 9) for t in refs]
        edge = sorted(scores)[-k]
        got = {}
        for x, s, n, y in zip(*(levels[c].to_pylist() for c in ("q", "score", "n", "labels")), strict=True):
            if x == q:
                got[round(s, 9)] = tuple(np.add(got.get(round(s, 9), (0, 0.0)), (n, y)))
        assert got == {s: (scores.count(s), sum(y for y, t in zip(labels, scores, strict=True) if t == s)) for s in set(scores) if s >= edge}
    if not weights:
        rows = nearest.closest_rows(k, 50)(left, pa.table({"r": list(range(2000))[::-1], "text": refs[::-1], "label": labels}))
        for q, text in enumerate(asked):
            wanted = sorted((-_score(text, t, None), r) for r, t in enumerate(refs))[:k]
            assert sorted((-s, r) for x, r, s in zip(*(rows[c].to_pylist() for c in ("q", "r", "score")), strict=True) if x == q) == wanted


def test_groups_that_exclude_little_are_left():
    texts = pa.table({"text": ["A" * 44 + t for t in _families(300, 6, 4)]})
    assert len(nearest.Side(texts["text"], 50).starts) < 100
    assert len(nearest._cell(texts, texts, 50, None, 1, 0.0).asked.starts) == 300


def test_near_copies_are_dealt_together(spark):
    """A family lies in one block, whichever letters it agrees on, and a part that all strings share fills no block."""
    rows = spark.createDataFrame(list(enumerate(_families(2000, 50, 5, fixed=20))), "q long, text string")
    [(count, texts, near)] = joins._counted([rows], 50)
    assert count == 2000 and abs(texts - len(set(r["text"] for r in rows.collect()))) < 200
    dealt = joins._dealt(rows, near, 8).collect()
    sizes = np.bincount([r["block"] for r in dealt], minlength=8)
    assert sizes.sum() == 2000 and sizes.max() < 600
    rows = spark.createDataFrame(list(enumerate(_families(2000, 50, 6))), "q long, text string")
    blocks = {}
    for r in joins._dealt(rows, joins._counted([rows], 50)[0][2], 8).collect():
        blocks.setdefault(r["q"] // 5, set()).add(r["block"])
    assert sum(len(b) > 1 for b in blocks.values()) <= 8
