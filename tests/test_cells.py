"""How nearest-neighbour searches are cut into cells, and what is read for them."""

import os

import numpy as np
import pytest

from helixframe.operators import joins, nearest
from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_cells_are_as_few_as_keep_the_cores_busy():
    assert nearest.grid(3000, 14000, 6) == (1, 1)
    assert nearest.grid(0, 0, 6) == (1, 1)
    assert nearest.grid(18_000, 84_000, 6) == (1, 6)
    assert nearest.grid(180_000, 840_000, 6) == (3, 6)
    for asked, held, cores in ((10**7, 10**6, 6), (10**6, 10**8, 96), (10**9, 10, 6)):
        across, down = nearest.grid(asked, held, cores)
        assert across * nearest.QUERIES >= asked and down * nearest.REFERENCES >= held
        assert across * down <= max(3 * cores + max(across, down), -(-asked // nearest.QUERIES) * -(-held // nearest.REFERENCES))


@pytest.mark.parametrize("blocks", [8, 300])
def test_a_frequent_value_fills_no_block(spark, blocks):
    """Half of the rows agree on the part by which they are dealt; the others lie in families."""
    rng = np.random.default_rng(1)
    texts = ["".join("ACGT"[c] for c in rng.integers(0, 4, 30)) for _ in range(8000)]
    tails = ["".join("ACGT"[c] for c in rng.integers(0, 4, 20)) for _ in range(800)]
    rows = [(i, t + ("A" * 20 if i < 4000 else tails[i // 5 % 800])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "q long, text string")
    near = joins._counted([df], 50)[0][2]
    dealt = joins._dealt(df, near, blocks).collect()
    assert len(dealt) == 8000 and {r["q"] for r in dealt} == set(range(8000))
    assert np.bincount([r["block"] for r in dealt], minlength=blocks).max() < 2.5 * 8000 / blocks + 20
    families = {}
    for r in dealt:
        if r["q"] >= 4000:
            families.setdefault(r["q"] // 5, set()).add(r["block"])
    assert blocks > 8 or all(len(f) == 1 for f in families.values())


def test_rows_are_dealt_without_a_sample(spark):
    """Neither a sort nor a shuffle stands between rows and their block: a sample would derive them twice."""
    df = spark.createDataFrame([(i, "ACGTA" * 10) for i in range(9)], "q long, text string")
    plan = _plan(joins._dealt(df, joins._counted([df], 50)[0][2], 4))
    assert "Exchange" not in plan and "rangepartitioning" not in plan


def test_one_row_a_text_without_a_sort(spark):
    """The lowest of equal references, with its label even where that is missing; sides without rows give none."""
    base = "ACGTTGCAAC" * 5
    queries = spark.createDataFrame([(1, base), (2, base[::-1])], "q long, text string")
    references = spark.createDataFrame([(9, base, 9.0), (4, base, None), (5, base, 5.0), (7, base[:-1] + "A", 7.0)], "r long, text string, label double")
    closest = joins.closest_rows(queries, references, 1)
    assert "Window" not in _plan(closest)
    found = {r["q"]: (r["r"], r["score"], r["label"]) for r in joins.nearest_first(closest).collect()}
    apart = lambda a, b: float(sum(x == y for x, y in zip(a, b, strict=True)))
    wanted = min([(-apart(base[::-1], base), 4, None), (-apart(base[::-1], base[:-1] + "A"), 7, 7.0)], key=lambda x: x[:2])
    assert found == {1: (4, 50.0, None), 2: (wanted[1], -wanted[0], wanted[2])}
    for a, b in ((queries.limit(0), references), (queries, references.limit(0)), (queries.limit(0), references.limit(0))):
        assert joins.closest_rows(a, b, 1).count() == 0 and joins.closest_levels(a, b, 1).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["pip12_neighbour_audit", "jon13_nearest_first"])
def test_labelled_strings_are_derived_once(spark, name):
    plan = _plan(catalog.queries()[name](spark, SF))
    assert "FileScan" not in plan and "Scan parquet" not in plan
