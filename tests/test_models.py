"""Models against direct solutions, finite differences and round trips."""

from functools import partial

import numpy as np
import pytest

from helixframe.models import features, linear, networks, trees
from helixframe.models.features import encode, kmer_matrix


def _data(n=60, length=12, seed=0):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ACGT"), length)) for _ in range(n)]
    y = np.array([t.count("G") * 0.3 + (t[0] == "A") for t in texts]) + rng.normal(scale=0.05, size=n)
    return texts, y


@pytest.fixture(scope="module")
def rows(spark):
    texts, y = _data()
    return spark.createDataFrame([(i, t, float(v), i % 3) for i, (t, v) in enumerate(zip(texts, y, strict=True))], "sample_index long, sequence string, y double, fold int").repartition(3)


def test_feature_shapes():
    codes = features.encode(["ACGT" * 12 + "AC"] * 2)
    assert features.kmer_matrix(codes).shape == (2, 85) and features.position_matrix(codes).shape == (2, 1069)
    assert features.position_codes(codes).shape == (2, 50 + 49 + 48)
    assert features.position_codes(features.encode(["CA"]), (1, 2)).tolist() == [[1, 64, 128 + 4]]
    with pytest.raises(ValueError):
        features.encode(["ACGN"])


def test_ridge_equals_the_direct_solution(rows):
    texts, y = _data()
    model = linear.Ridge.fit(rows, alpha=2.0)
    x = features.Standard(features.kmer_matrix(features.encode(texts)))(features.kmer_matrix(features.encode(texts)))
    w = np.linalg.solve(x.T @ x + 2.0 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(model.predict(texts), x @ w + y.mean(), atol=1e-8)


def test_conjugate_gradients_equal_the_dense_solution(rows):
    texts, y = _data()
    model = linear.PositionRidge.fit(rows, alpha=3.0, ks=(1, 2))
    at = features.position_codes(features.encode(texts), (1, 2))
    x = np.zeros((len(texts), 64 * (12 + 11)))
    x[np.arange(len(texts))[:, None], at] = 1
    w = np.linalg.solve(x.T @ x + 3.0 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(model.weights, w, atol=1e-6)
    with pytest.raises(ValueError, match="converge"):
        linear.PositionRidge.fit(rows, alpha=1e-9, most=1)


def test_support_vectors(tmp_path, spark, rows):
    texts, y = _data()
    model = linear.fit_svr(texts, y, epsilon=0.05)
    assert np.abs(model.coefficients).max() <= 1 + 1e-9 and np.abs(model.predict(texts) - y).mean() < y.std()
    z = (features.kmer_matrix(features.encode(texts)) - model.mean) / model.scale
    direct = [sum(c * np.exp(-model.gamma * ((v - x) ** 2).sum()) for v, c in zip(model.vectors, model.coefficients, strict=True)) + model.bias for x in z]
    assert np.allclose(model.predict(texts, batch=7), direct)
    model.save(f"{tmp_path}/m.npz")
    again = linear.SupportVectors.load(f"{tmp_path}/m.npz")
    assert (again.predict(texts) == model.predict(texts)).all()
    scored = {r["sample_index"]: r["score"] for r in linear.score_rows(rows, model.predict).collect()}
    assert np.allclose([scored[i] for i in range(len(texts))], model.predict(texts))


def test_kernel_ridge_interpolates_with_a_small_penalty():
    texts, y = _data(30)
    model = linear.KernelRidge.fit(texts, y, alpha=1e-8)
    assert np.allclose(model.predict(texts), y, atol=1e-3)


def test_fourier_features_approach_the_kernel():
    texts, _ = _data(80)
    f = linear.FourierFeatures.fit(texts, count=6000, gamma=0.01, seed=1)
    z = f.standard(f.base(features.encode(texts)))
    assert np.abs(f(features.encode(texts)) @ f(features.encode(texts)).T - linear.gaussian_kernel(z, z, 0.01)).max() < 0.08


@pytest.mark.parametrize("make", [networks.MotifCnn, networks.multiscale_cnn, networks.PositionMlp, networks.KmerMlp, networks.Recurrent, networks.Gated])
@pytest.mark.parametrize("name", ["mse", "huber", "rank", "tail", "balanced"])
def test_gradients(make, name):
    texts, y = _data(9, 14)
    model, rng = make(), np.random.default_rng(1)
    x = model.prepare(texts)
    arrays = model.start(x, rng)
    out, kept = model.forward(arrays, x)
    slopes = model.backward(arrays, kept, networks.loss(name, out, y)[1])
    assert slopes.keys() == arrays.keys()
    for key in arrays:
        flat = arrays[key].reshape(-1)
        for k in rng.choice(len(flat), size=min(3, len(flat)), replace=False):
            before, step = flat[k], 1e-6
            flat[k] = before + step
            up = networks.loss(name, model.forward(arrays, x)[0], y)[0]
            flat[k] = before - step
            down = networks.loss(name, model.forward(arrays, x)[0], y)[0]
            flat[k] = before
            assert (up - down) / (2 * step) == pytest.approx(slopes[key].reshape(-1)[k], rel=2e-3, abs=2e-6)


def test_autoencoder_gradients_and_draws(tmp_path):
    texts, y = _data(7, 6)
    vae = networks.ConditionalVae(latent=3, hidden=5).fit(texts, y, epochs=1, seed=1)
    x = features.one_hot(features.encode(texts)).reshape(len(texts), -1)
    c, noise = ((y - vae.mean) / vae.scale)[:, None], np.random.default_rng(2).normal(size=(7, 3))
    total = lambda: (lambda r, k, _: r + vae.beta * k)(*vae.losses(vae.arrays, x, c, noise))
    slopes = vae.losses(vae.arrays, x, c, noise)[2]
    rng = np.random.default_rng(3)
    for key, values in vae.arrays.items():
        flat = values.reshape(-1)
        for k in rng.choice(len(flat), size=min(3, len(flat)), replace=False):
            before, step = flat[k], 1e-6
            flat[k] = before + step
            up = total()
            flat[k] = before - step
            down = total()
            flat[k] = before
            assert (up - down) / (2 * step) == pytest.approx(slopes[key].reshape(-1)[k], rel=2e-3, abs=2e-6)
    vae.save(f"{tmp_path}/v.npz")
    assert networks.ConditionalVae.load(f"{tmp_path}/v.npz").draw([1, 2], [0.1, 0.9], 5) == vae.draw([1, 2], [0.1, 0.9], 5)
    assert vae.draw([2], [0.9], 5) == vae.draw([1, 2], [0.1, 0.9], 5)[1:]


def test_training_without_validation_keeps_the_trained_weights():
    texts, y = _data(200)
    model = networks.PositionMlp().fit(texts, y, epochs=30, batch=32, seed=1)
    assert np.abs(model.predict(texts) - y).mean() < 0.5 * np.abs(y - y.mean()).mean()


def test_network_round_trip(tmp_path):
    texts, y = _data(40)
    for model in (networks.multiscale_cnn(), networks.KmerMlp(), networks.Gated()):
        model.fit(texts, y, epochs=1)
        model.save(f"{tmp_path}/n.npz")
        assert np.allclose(type(model).load(f"{tmp_path}/n.npz").predict(texts), model.predict(texts))
    with pytest.raises(ValueError):
        networks.MotifCnn.load(f"{tmp_path}/n.npz")
    assert len(networks.MotifCnn().fit(texts, y, epochs=1).top_windows(texts, 7, 0, 5)) == 5


def _constant(value, texts):
    return np.full(len(texts), value)


def test_out_of_fold_fits_on_a_bounded_sample_and_predicts_all_rows(rows):
    seen = []
    found = linear.out_of_fold(rows, lambda texts, y: seen.append(len(texts)) or partial(_constant, 0.0), most=10).collect()
    assert seen == [10, 10, 10] and len(found) == 60


def test_extra_trees(spark):
    texts, y = _data(200)
    x = kmer_matrix(encode(texts))
    tree = trees.random_tree(x, y, (0, 3), leaf=8)
    at = np.zeros(len(x), dtype=int)
    for i, row in enumerate(x):
        while tree.feature[at[i]] >= 0:
            at[i] = tree.left[at[i]] if row[tree.feature[at[i]]] <= tree.cut[at[i]] else tree.right[at[i]]
    for node in set(at.tolist()):
        assert (at == node).sum() >= 8 and tree.value[node] == pytest.approx(y[at == node].mean())
    assert len(set(at.tolist())) > 5 and np.allclose(tree.predict(x), tree.value[at])
    model = trees.extra_trees(spark, texts, y, trees=6, leaf=8, seed=0)
    assert np.allclose(model.predict(texts), np.mean([trees.random_tree(x, y, (0, k), 8).predict(x) for k in range(6)], axis=0))


def test_histogram_boosting_against_direct_search():
    """The first tree's splits, found again by trying every cut of every feature on the rows themselves."""
    texts, y = _data(120)
    x = kmer_matrix(encode(texts))
    model = trees.histogram_boosting(texts, y, rounds=1, rate=1.0, leaves=4, least=10)

    def best(rows):
        out = (0.0, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                side = x[rows, f] <= cut
                if 10 <= side.sum() <= len(rows) - 10:
                    a, b = y[rows][side], y[rows][~side]
                    gain = len(a) * (a.mean() - y[rows].mean()) ** 2 + len(b) * (b.mean() - y[rows].mean()) ** 2
                    out = max(out, (gain, (rows[side], rows[~side])), key=lambda o: round(o[0], 12))
        return out

    leaves = [np.arange(len(y))]
    while len(leaves) < 4:
        found = [best(rows) for rows in leaves]
        k = max(range(len(found)), key=lambda i: found[i][0])
        leaves = [*leaves[:k], *found[k][1], *leaves[k + 1 :]]
    wanted = np.empty(len(y))
    for rows in leaves:
        wanted[rows] = y[rows].mean()
    assert ((model.predict(texts) - y) ** 2).sum() == pytest.approx(((wanted - y) ** 2).sum(), rel=1e-9)
    errors = [np.abs(trees.histogram_boosting(texts, y, rounds=n).predict(texts) - y).mean() for n in (1, 20, 60)]
    assert errors[0] > errors[1] > errors[2]


def test_windows_that_excite_filters(spark, rows):
    texts, y = _data()
    model = networks.MotifCnn(options={"filters": [(7, 4)], "bins": 5}).fit(texts, y, epochs=1)
    found = networks.excited_windows(rows.repartition(5), model, 7, 4, 9).collect()
    for f in range(4):
        own = [r["sequence"] for r in sorted((r for r in found if r["filter"] == f), key=lambda r: r["place"])]
        assert own == model.top_windows(texts, 7, f, 9)


def test_out_of_fold_predicts_every_row_once(rows):
    found = linear.out_of_fold(rows, lambda texts, y: partial(_constant, float(y.mean()))).collect()
    texts, y = _data()
    assert sorted(r["sample_index"] for r in found) == list(range(60))
    for r in found:
        assert r["predicted"] == pytest.approx(y[np.arange(60) % 3 != r["fold"]].mean())


def test_blend_grid():
    grid = linear.blend_grid(0.1)
    assert len(grid) == 66 and all(abs(sum(w) - 1) < 1e-9 for w in grid)
    with pytest.raises(ValueError):
        linear.blend_grid(0.3)
