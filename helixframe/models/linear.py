"""Linear and kernel predictors.

Sums over rows (Gram matrices, weighted counts) are taken by Spark; what the driver solves
has the size of the features.  Predicting runs on the executors, batch by batch, with the
weights sent along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.models.features import Standard, encode, kmer_matrix, position_codes
from helixframe.shipping import arrow_map

Featurizer = Callable[[np.ndarray], np.ndarray]


def score_rows(rows: DataFrame, predict: Callable[[list[str]], np.ndarray], key: str = "sample_index", name: str = "score") -> DataFrame:
    """``(key, name)``: ``predict`` over the strings of a table, batch by batch on the executors.

    Equal strings are scored once a batch.
    """
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(predict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("sequence").to_pylist()
            once = sorted(set(texts))
            found = dict(zip(once, np.asarray(own(once), dtype=np.float64).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([found[t] for t in texts], pa.float64())], names=[key, name])

    return arrow_map(rows.select(key, "sequence"), run, f"{key} {kind}, {name} double")


def gram(rows: DataFrame, featurize: Featurizer, label: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, X'X and X'y of the features with a leading column of ones, summed over partitions.

    Each partition yields one matrix; they are added up on the driver, whose memory holds
    matrices of the size of the features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, xx, xy = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = featurize(encode(batch.column("sequence").to_pylist()))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = np.asarray(batch.column(label).to_pylist(), dtype=np.float64)
            n += len(x)
            xx = x.T @ x if xx is None else xx + x.T @ x
            xy = x.T @ y if xy is None else xy + x.T @ y
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([xx.tobytes()], pa.binary()), pa.array([xy.tobytes()], pa.binary())], names=["n", "xx", "xy"])

    total, xx, xy = 0, 0.0, 0.0
    for r in arrow_map(rows.select("sequence", label), run, "n long, xx binary, xy binary").toLocalIterator():
        v = np.frombuffer(r["xy"])
        total, xx, xy = total + r["n"], xx + np.frombuffer(r["xx"]).reshape(len(v), len(v)), xy + v
    return total, xx, xy


@dataclass
class Ridge:
    """Standardised ridge with a free intercept; penalty alpha on the standardised weights."""

    featurize: Featurizer
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, rows: DataFrame, featurize: Featurizer = kmer_matrix, label: str = "y", alpha: float = 1.0) -> Ridge:
        n, xx, xy = gram(rows, featurize, label)
        if not n:
            raise ValueError("no rows to fit on")
        mean, second = xx[0, 1:] / n, np.diag(xx)[1:] / n
        scale = np.sqrt(np.maximum(0.0, second - mean**2))
        scale = np.where(scale < 1e-12, 1.0, scale)
        centred = (xx[1:, 1:] - n * np.outer(mean, mean)) / np.outer(scale, scale)
        target = (xy[1:] - mean * xy[0]) / scale
        weights = np.linalg.solve(centred + alpha * np.eye(len(mean)), target)
        return cls(featurize, mean, scale, weights, float(xy[0] / n))

    def predict(self, texts: list[str]) -> np.ndarray:
        return (self.featurize(encode(texts)) - self.mean) / self.scale @ self.weights + self.intercept


@dataclass
class PositionRidge:
    """Ridge over the implicit position k-mer design, by conjugate gradients; columns are not standardised.

    Each step's products are sums over rows that Spark takes on the long form: Xv is a
    lookup and X'u a count, never a matrix.
    """

    ks: tuple[int, ...]
    weights: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, rows: DataFrame, label: str = "y", alpha: float = 1.0, ks: tuple[int, ...] = (1, 2, 3), tolerance: float = 1e-8, most: int = 1000) -> PositionRidge:
        first = rows.select("sequence").first()
        if first is None:
            raise ValueError("no rows to fit on")
        length = len(first["sequence"])
        width = 64 * sum(length - k + 1 for k in ks)
        rows = rows.select("sequence", label).cache()  # every step reads them again
        mean = rows.agg(F.avg(label)).first()[0]
        # The right side and the operator are applied partition by partition on the executors.
        b = cls._transposed(rows, label, ks, width, None, mean)
        w = np.zeros(width)
        r, p = b.copy(), b.copy()
        rr, start = float(r @ r), float(np.sqrt(b @ b)) or 1.0
        for _ in range(most):
            if np.sqrt(rr) <= tolerance * start:
                break
            q = cls._transposed(rows, label, ks, width, p, 0.0) + alpha * p
            step = rr / float(p @ q)
            w, r = w + step * p, r - step * q
            rr, before = float(r @ r), rr
            p = r + rr / before * p
        else:
            raise ValueError("conjugate gradients did not converge")
        rows.unpersist()
        return cls(ks, w, mean)

    @staticmethod
    def _transposed(rows: DataFrame, label: str, ks: tuple[int, ...], width: int, vector: np.ndarray | None, mean: float) -> np.ndarray:
        """X'(y - mean) where ``vector`` is None, else X'(X vector)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    at = position_codes(encode(batch.column("sequence").to_pylist()), ks)
                    u = np.asarray(batch.column(label).to_pylist()) - mean if vector is None else vector[at].sum(axis=1)
                    out += np.bincount(at.ravel(), weights=np.repeat(u, at.shape[1]), minlength=width)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

        parts = arrow_map(rows.select("sequence", label), run, "v binary").toLocalIterator()
        return sum((np.frombuffer(r["v"]) for r in parts), np.zeros(width))

    def predict(self, texts: list[str]) -> np.ndarray:
        return self.weights[position_codes(encode(texts), self.ks)].sum(axis=1) + self.intercept


@dataclass
class FourierFeatures:
    """Random Fourier features of standardised base features for a Gaussian kernel."""

    base: Featurizer
    standard: Standard
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def fit(cls, sample: list[str], base: Featurizer = kmer_matrix, count: int = 256, gamma: float | None = None, seed: int = 0) -> FourierFeatures:
        x = base(encode(sample))
        standard = Standard(x)
        rng = np.random.default_rng(seed)
        if gamma is None:
            z, half = standard(x), len(x) // 2
            gamma = 1.0 / float(((z[:half] - z[half : 2 * half]) ** 2).sum(axis=1).mean())
        return cls(base, standard, rng.normal(scale=np.sqrt(2 * gamma), size=(x.shape[1], count)), rng.uniform(0, 2 * np.pi, count))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phases)) * np.cos(self.standard(self.base(codes)) @ self.directions + self.phases)


def gaussian_kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0.0))


@dataclass
class SupportVectors:
    """Prediction of a Gaussian support vector regressor from its exported arrays."""

    base: Featurizer
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    coefficients: np.ndarray
    bias: float
    gamma: float

    def predict(self, texts: list[str], batch: int = 128) -> np.ndarray:
        z = (self.base(encode(texts)) - self.mean) / self.scale
        return np.concatenate([gaussian_kernel(z[i : i + batch], self.vectors, self.gamma) @ self.coefficients + self.bias for i in range(0, len(z), batch)]) if len(z) else np.empty(0)

    def save(self, path: str) -> None:
        np.savez(path, schema=np.array("gaussian-svr-1"), mean=self.mean, scale=self.scale, vectors=self.vectors, coefficients=self.coefficients, bias=self.bias, gamma=self.gamma)

    @classmethod
    def load(cls, path: str, base: Featurizer = kmer_matrix) -> SupportVectors:
        with np.load(path, allow_pickle=False) as f:
            if str(f["schema"]) != "gaussian-svr-1":
                raise ValueError(f"{path} holds {f['schema']}")
            arrays = [f[k] for k in ("mean", "scale", "vectors", "coefficients")]
            if not all(np.isfinite(a).all() for a in arrays):
                raise ValueError(f"{path} holds numbers that are not finite")
            return cls(base, *arrays, float(f["bias"]), float(f["gamma"]))


def _largest_eigenvalue(k: np.ndarray, rounds: int = 30) -> float:
    """Of a symmetric matrix without negative numbers, by power iteration."""
    v = np.full(len(k), 1 / np.sqrt(len(k)))
    for _ in range(rounds):
        w = k @ v
        v = w / np.linalg.norm(w)
    return float(v @ k @ v)


def fit_svr(texts: list[str], y: np.ndarray, base: Featurizer = kmer_matrix, c: float = 1.0, epsilon: float = 0.1, steps: int = 300) -> SupportVectors:
    """Gaussian support vector regression on one machine's rows: projected gradient on the dual, bias from its mean residual.

    The kernel's gamma is 1 / (features * variance), the variance taken after scaling.
    """
    x = base(encode(texts))
    standard = Standard(x)
    z = standard(x)
    gamma = 1.0 / (z.shape[1] * max(z.var(), 1e-12))
    k = gaussian_kernel(z, z, gamma)
    lipschitz = 1.05 * _largest_eigenvalue(k) + 1e-9
    beta, bias, last, t = np.zeros(len(y)), float(np.mean(y)), np.zeros(len(y)), 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point = beta + (t - 1) / t2 * (beta - last)
        move = point - (k @ point - (y - bias)) / lipschitz
        last, beta, t = beta, np.clip(np.sign(move) * np.maximum(np.abs(move) - epsilon / lipschitz, 0), -c, c), t2
        bias = float(np.median(y - k @ beta))
    keep = np.abs(beta) > 1e-8
    return SupportVectors(base, standard.mean, standard.scale, z[keep], beta[keep], bias, gamma)


@dataclass
class KernelRidge:
    """Gaussian kernel ridge on one machine's rows (a fold's), solved directly."""

    base: Featurizer
    standard: Standard
    rows: np.ndarray
    dual: np.ndarray
    mean: float
    gamma: float

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, alpha: float = 1.0, base: Featurizer = kmer_matrix) -> KernelRidge:
        x = base(encode(texts))
        standard = Standard(x)
        z = standard(x)
        gamma = 1.0 / (z.shape[1] * max(z.var(), 1e-12))
        dual = np.linalg.solve(gaussian_kernel(z, z, gamma) + alpha * np.eye(len(z)), y - y.mean())
        return cls(base, standard, z, dual, float(y.mean()), gamma)

    def predict(self, texts: list[str]) -> np.ndarray:
        return gaussian_kernel(self.standard(self.base(encode(texts))), self.rows, self.gamma) @ self.dual + self.mean


@dataclass
class Calibrated:
    """A model whose predictions go through an affine calibration."""

    model: KernelRidge
    slope: float
    intercept: float

    def predict(self, texts: list[str]) -> np.ndarray:
        return self.intercept + self.slope * self.model.predict(texts)


# --------------------------------------------------------------------------- folds and blends


#: Most rows that a kernel model is fitted on: its kernel has their square.
MOST_KERNEL = 2000


def hashed_sample(rows: DataFrame, most: int, label: str = "y") -> tuple[list[str], np.ndarray]:
    """Strings and labels of at most ``most`` rows, those of least hash of their index, in that order."""
    found = rows.orderBy(F.xxhash64("sample_index", F.lit(11)), "sample_index").limit(most).select("sequence", F.col(label).cast("double").alias("label")).collect()
    return [r["sequence"] for r in found], np.array([r["label"] for r in found])


def out_of_fold(rows: DataFrame, fit: Callable[[list[str], np.ndarray], Callable[[list[str]], np.ndarray]], fold: str = "fold", label: str = "y", most: int = MOST_KERNEL) -> DataFrame:
    """``(sample_index, fold, observed, predicted)``: every row predicted by a model fitted on other folds.

    A fold's model is fitted on a hash sample of at most ``most`` rows of the others; all its
    rows are predicted, batch by batch on the executors.
    """
    folds = [r["fold"] for r in rows.select(F.col(fold).alias("fold")).distinct().orderBy("fold").collect()]
    models = {k: fit(*hashed_sample(rows.where(F.col(fold) != k), most, label)) for k in folds}
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, at = np.array(batch.column("sequence").to_pylist(), dtype=object), np.asarray(batch.column("fold").to_pylist())
            out = np.zeros(len(at))
            for k in set(at.tolist()):
                out[at == k] = own[k](texts[at == k].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("sample_index"), batch.column("fold"), batch.column("observed"), pa.array(out)], names=["sample_index", "fold", "observed", "predicted"])

    table = rows.select("sample_index", "sequence", F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("observed"))
    return arrow_map(table, run, "sample_index long, fold int, observed double, predicted double")


def blend_grid(step: float = 0.1) -> list[tuple[float, float, float]]:
    """Weights of three scores on a simplex grid; the step must divide 1."""
    n = round(1 / step)
    if abs(n * step - 1) > 1e-9:
        raise ValueError("the step must divide 1")
    return [(i / n, j / n, (n - i - j) / n) for i in range(n + 1) for j in range(n + 1 - i)]


def grid_search(rows: DataFrame, scores: tuple[str, str, str], observed: str, step: float = 0.1) -> DataFrame:
    """``(w0, w1, w2, mae)`` of every blend, from one pass over the rows."""
    values = ", ".join(f"({a!r}D, {b!r}D, {c!r}D)" for a, b, c in blend_grid(step))
    grid = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(w0, w1, w2)")
    error = F.abs(F.col("w0") * F.col(scores[0]) + F.col("w1") * F.col(scores[1]) + F.col("w2") * F.col(scores[2]) - F.col(observed))
    return rows.crossJoin(F.broadcast(grid)).groupBy("w0", "w1", "w2").agg(F.round(F.avg(error), 6).alias("mae"))
