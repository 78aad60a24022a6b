"""Sides that grow with the data are never broadcast, however small a guess takes them to be."""

import pytest

from helixframe.operators import graph, joins


def _rows(spark):
    base = "ACGTTGCAAC" * 5
    texts = [base, "C" + base[1:], base[:-1] + "A", base[::-1], base]
    return spark.createDataFrame(list(enumerate(texts)), "sample_index long, sequence string")


def _texts(spark):
    return _rows(spark).selectExpr("sequence AS text")


def _components(spark):
    nodes = spark.range(6)
    return graph.connected_components(nodes, spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "i long, j long"))


def _witness(spark):
    windows = _rows(spark).selectExpr("sample_index AS ext_id", "0 AS shift", "'forward' AS orientation", "sequence AS window")
    return joins.best_witness(windows, joins.hamming_pairs(_texts(spark), _texts(spark), 5, 50), "ext_id")


PLANS = {
    "F2, F19, F20 hamming_self_join": lambda s: joins.hamming_self_join(_rows(s), 2, 50),
    "F1, F17 components": _components,
    "F16 labels": lambda s: graph.canonical_labels(_components(s)).select("id", "root"),
    "F3, F5 witness": _witness,
    "F4, F6 hamming_pairs": lambda s: joins.hamming_pairs(_texts(s), _texts(s), 5, 50),
    "F8 masked_self_join": lambda s: joins.masked_self_join(_rows(s), 50, 5, 8, 10),
    "F15, F18 edit_pairs": lambda s: joins.edit_pairs(_texts(s), _texts(s), 5, 50),
}


@pytest.mark.parametrize("name", PLANS)
def test_growing_sides_are_sorted(spark, name):
    plan = PLANS[name](spark)._jdf.queryExecution().sparkPlan().toString()
    joined = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "range#" not in line]
    assert "SortMergeJoin" in plan and not joined


def test_masks_miss_no_pair(spark):
    """Ten substitutions laid as badly as can be: no segment is spared."""
    base = "ACGT" * 12 + "AC"
    swap = str.maketrans("ACGT", "CGTA")
    rows = [(0, base)]
    for k, counts in enumerate(((2, 2, 2, 2, 2), (1, 1, 1, 1, 6), (1, 1, 1, 2, 5), (0, 0, 0, 0, 10), (2, 2, 2, 3, 1), (3, 3, 4, 0, 0), (2, 2, 2, 2, 3))):
        places = {g * 10 + i * 10 // max(n, 1) for g, n in enumerate(counts) for i in range(n)}
        rows.append((k + 1, "".join(c.translate(swap) if p in places else c for p, c in enumerate(base))))
    found = joins.masked_self_join(spark.createDataFrame(rows, "sample_index long, sequence string"), 50, 5, 8, 10)
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    wanted = sorted((i, j, apart(a, b)) for i, a in rows for j, b in rows if i < j and apart(a, b) <= 10)
    assert sorted(map(tuple, found.collect())) == wanted
