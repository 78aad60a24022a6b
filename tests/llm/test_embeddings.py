import numpy as np
import pytest

from helixframe.llm import embeddings as E
from tests.llm.texts import Union

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=400, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i * 2, base[i].astype(np.float32).tolist(), 0) for i in range(n)]
    for i in range(120):
        rows.append((5000 + i, (base[i % 15] + rng.normal(scale=0.25, size=dim)).astype(np.float32).tolist(), 1))
    rows += [(7000 + i, base[3].astype(np.float32).tolist(), 1) for i in range(5)]
    rows += [(8000, None, 0), (8001, [0.0] * dim, 0), (8002, [float("nan")] * dim, 0), (8003, [None] * dim, 0), (8004, [], 0), (8005, [float("inf")] + [1.0] * (dim - 1), 0), (8006, [1.0, 2.0], 0), (8007, [2.0, 4.0], 0)]
    rows += [(None, base[9].astype(np.float32).tolist(), 0), (5000, rows[n][1], 1)]
    return rows


def test_nearest_e8_is_the_nearest_point():
    rng = np.random.default_rng(4)
    x = rng.uniform(-3, 3, size=(200, 8))
    found = E.nearest_e8(x)
    whole = np.isclose(found, np.rint(found)).all(axis=1) | np.isclose(found - 0.5, np.rint(found - 0.5)).all(axis=1)
    assert whole.all() and np.allclose(found.sum(axis=1) % 2, 0)
    gap = ((x - found) ** 2).sum(axis=1)
    for root in E.minimal_vectors():
        assert (((x - found - root) ** 2).sum(axis=1) >= gap - 1e-9).all()
    assert len(E.minimal_vectors()) == 240 and np.allclose((E.minimal_vectors() ** 2).sum(axis=1), 2)


def test_first_probe_is_the_own_cell():
    x = np.random.default_rng(1).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for design in (E.Design(5, 2, 1.6), E.Design(5, 4, 1.8)):
        assert (E.cells(x, 8, design)[:, :, :1] == E.cells(x, 1, design)).all()
        assert all(len(set(k)) == 8 for k in E.cells(x, 8, design).reshape(-1, 8).tolist())


def test_links_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'y' AS cell", "1 AS kept")
    found = E.near_vectors(df).collect()
    assert len(found) == len(rows)
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if E.usable(v) is not None]
    own, links = Union(), {}
    for a, (i, u) in enumerate(good):
        for b, (j, v) in enumerate(good):
            if a != b and len(u) == len(v) and E.cosine(u, v) >= 0.9:
                links.setdefault((a, i), 0)
                links[a, i] += 1
                if i is not None and j is not None:
                    own.join(i, j)
    total = sum(links.values())
    assert sum(r["n_links"] for r in found) >= 0.9 * total > 0
    assert sum(r["n_links"] for r in found) <= total
    right = [r["component_id"] == own.find(r["vec_id"]) for r in found if r["vec_id"] is not None]
    assert np.mean(right) > 0.97
    by = {r["vec_id"]: r for r in found}
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in range(8000, 8006))
    assert by[8006]["n_links"] == 1 and by[8007]["component_id"] == 8006


@pytest.mark.parametrize(("design", "dim"), [(d, dim) for d in E.DESIGNS[:5] for dim in (16, 64)] + [(E.DESIGNS[0], 384), (E.DESIGNS[5], 64)])
def test_recall_at_the_threshold(design, dim):
    """Pairs at cosine 0.9 exactly meet with probability 0.9 at least, under every design."""
    rng = np.random.default_rng(6)
    u = rng.normal(size=(max(300, 40_000 // design.tables), dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.9 * u + np.sqrt(1 - 0.81) * w
    met = [[], []]
    for k in range(0, len(u), 200):
        x, y = u[k : k + 200], v[k : k + 200]
        met[0].append((E.cells(x, E.PROBES, design) == E.cells(y, 1, design)).any(axis=(1, 2)))
        met[1].append((E.cells(y, E.PROBES, design) == E.cells(x, 1, design)).any(axis=(1, 2)))
    assert (np.concatenate(met[0]) | np.concatenate(met[1])).mean() >= 0.9


def test_candidates_of_unrelated_vectors_stay_few():
    """The expected candidates a vector don't grow with the table, and neither do measured ones beyond their chance."""
    few = [n * E.design_for(n).chance(E.PROBES) for n in (10**k for k in range(3, 9))]
    assert max(few) < 100
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    design = E.DESIGNS[0]
    home, seek = E.cells(x, 1, design)[:, :, 0], E.cells(x, E.PROBES, design)
    pairs = sum(np.isin(seek[:, t].ravel(), home[:, t]).sum() - len(x) for t in range(design.tables))
    assert pairs <= 2 * design.chance(E.PROBES) * len(x) ** 2


def test_rows_of_a_shared_id_have_their_own_links(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=32), rng.normal(size=32)
    close = lambda x: (x + rng.normal(scale=0.01, size=32)).tolist()
    rows = [(5, a.tolist(), 0), (5, b.tolist(), 0), (7, close(a), 0), (9, close(b), 0), (11, rng.normal(size=32).tolist(), 0)]
    found = {}
    for r in E.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert found == {5: [(1, 5, True)] * 2, 7: [(1, 5, False)], 9: [(1, 5, False)], 11: [(0, 11, True)]}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 0.0], 0)]])
def test_tiny_tables(spark, rows):
    found = E.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found] == [(i, 0, i, True) for i, *_ in rows]
