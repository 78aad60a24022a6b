"""Small neural predictors and a conditional variational autoencoder, in NumPy.

They are trained on one machine (the driver, or one task a fold) and predict on the
executors.  A network is a set of named arrays and two functions: ``forward`` returns the
predictions and what the gradients need, ``backward`` the gradients.  Without validation
rows training keeps the last weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from helixframe.functions.bases import BASES
from helixframe.models.features import Standard, encode, kmer_matrix, one_hot

Arrays = dict[str, np.ndarray]

# --------------------------------------------------------------------------- training


class Adam:
    def __init__(self, arrays: Arrays, rate: float):
        self.rate, self.t = rate, 0
        self.first = {k: np.zeros_like(v) for k, v in arrays.items()}
        self.second = {k: np.zeros_like(v) for k, v in arrays.items()}

    def step(self, arrays: Arrays, slopes: Arrays) -> None:
        self.t += 1
        for k, g in slopes.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            move = (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)
            arrays[k] = arrays[k] - self.rate * move


def clip_norm(slopes: Arrays, most: float) -> Arrays:
    norm = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
    return slopes if norm <= most else {k: g * (most / norm) for k, g in slopes.items()}


def loss(name: str, predicted: np.ndarray, y: np.ndarray, edges: tuple[float, float] = (-0.43, 0.43)) -> tuple[float, np.ndarray]:
    """Loss and its slope in the predictions.

    ``mse``; ``huber`` with width 1; ``rank`` adds the pairwise logistic loss over the batch;
    ``tail`` weighs rows by their distance from the mean; ``balanced`` gives the three
    groups between ``edges`` equal weight.
    """
    n, e = len(y), predicted - y
    if name == "mse":
        return float((e * e).mean()), 2 * e / n
    if name == "huber":
        small = np.abs(e) <= 1
        return float(np.where(small, e * e / 2, np.abs(e) - 0.5).mean()), np.where(small, e, np.sign(e)) / n
    if name == "rank":
        sign = np.sign(y[:, None] - y[None, :])
        margin = np.clip(sign * (predicted[:, None] - predicted[None, :]), -30, 30)
        pairs = max(1, int((sign != 0).sum()))
        slope = np.where(sign != 0, -sign / (1 + np.exp(margin)), 0.0)
        value = np.where(sign != 0, np.log1p(np.exp(-margin)), 0.0).sum() / pairs
        return float((e * e).mean() + value), 2 * e / n + (slope.sum(axis=1) - slope.sum(axis=0)) / pairs
    if name == "tail":
        w = 1 + np.abs(y - y.mean())
    elif name == "balanced":
        group = np.digitize(y, edges)
        counts = np.bincount(group, minlength=3)
        w = 1.0 / np.maximum(1, counts[group])
    else:
        raise ValueError(f"unknown loss {name}")
    w = w / w.sum()
    return float((w * e * e).sum()), 2 * w * e


def _dense(rng, rows: int, columns: int) -> np.ndarray:
    return rng.normal(scale=np.sqrt(2 / rows), size=(rows, columns))


@dataclass
class Network:
    """A regressor over base codes: training with early stopping, prediction, saving."""

    arrays: Arrays = field(default_factory=dict)
    mean: float = 0.0
    scale: float = 1.0
    options: dict = field(default_factory=dict)

    def prepare(self, texts: list[str]) -> np.ndarray:
        return one_hot(encode(texts))

    def start(self, x: np.ndarray, rng) -> Arrays:
        raise NotImplementedError

    def forward(self, arrays: Arrays, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        raise NotImplementedError

    def backward(self, arrays: Arrays, kept: tuple, slope: np.ndarray) -> Arrays:
        raise NotImplementedError

    def fit(self, texts, y, validation=None, epochs: int = 30, batch: int = 128, rate: float = 1e-3, patience: int = 5, seed: int = 0, loss_name: str = "mse", clip: float = 5.0):
        """Adam on batches; with ``validation = (texts, y)`` the weights of least MAE are kept."""
        y = np.asarray(y, dtype=np.float64)
        rng = np.random.default_rng(seed)
        x = self.prepare(texts)
        self.mean, self.scale = float(y.mean()), float(y.std()) or 1.0
        z = (y - self.mean) / self.scale
        arrays = self.start(x, rng)
        adam, best, least, waited = Adam(arrays, rate), None, np.inf, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                out, kept = self.forward(arrays, x[rows])
                _, slope = loss(loss_name, out, z[rows])
                adam.step(arrays, clip_norm(self.backward(arrays, kept, slope), clip))
            if validation is not None:
                self.arrays = arrays
                error = float(np.abs(self.predict(validation[0]) - np.asarray(validation[1])).mean())
                if error < least - 1e-9:
                    best, least, waited = {k: v.copy() for k, v in arrays.items()}, error, 0
                else:
                    waited += 1
                    if waited >= patience:
                        break
        self.arrays = best or arrays
        return self

    def predict(self, texts: list[str]) -> np.ndarray:
        out = [self.forward(self.arrays, self.prepare(texts[i : i + 1024]))[0] for i in range(0, len(texts), 1024)]
        return np.concatenate(out) * self.scale + self.mean if out else np.empty(0)

    def save(self, path: str) -> None:
        np.savez(path, schema=np.array(type(self).__name__), mean=self.mean, scale=self.scale, **{f"w_{k}": v for k, v in self.arrays.items()}, **{f"o_{k}": np.asarray(v) for k, v in self.options.items()})

    @classmethod
    def load(cls, path: str):
        with np.load(path, allow_pickle=False) as f:
            if str(f["schema"]) != cls.__name__:
                raise ValueError(f"{path} holds a {f['schema']}, not a {cls.__name__}")
            arrays = {k[2:]: f[k] for k in f.files if k.startswith("w_")}
            if not all(np.isfinite(a).all() for a in arrays.values()):
                raise ValueError(f"{path} holds numbers that are not finite")
            return cls(arrays=arrays, mean=float(f["mean"]), scale=float(f["scale"]), options={k[2:]: f[k].tolist() for k in f.files if k.startswith("o_")})


def _head_start(arrays: Arrays, rng, inputs: int, hidden: int) -> Arrays:
    return arrays | {"w1": _dense(rng, inputs, hidden), "b1": np.zeros(hidden), "w2": _dense(rng, hidden, 1)[:, 0], "b2": np.zeros(1)}


def _head(a: Arrays, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(0, x @ a["w1"] + a["b1"])
    return h @ a["w2"] + a["b2"][0], h


def _head_back(a: Arrays, x: np.ndarray, h: np.ndarray, slope: np.ndarray) -> tuple[Arrays, np.ndarray]:
    dh = np.outer(slope, a["w2"]) * (h > 0)
    return {"w2": h.T @ slope, "b2": np.array([slope.sum()]), "w1": x.T @ dh, "b1": dh.sum(axis=0)}, dh @ a["w1"].T


class PositionMlp(Network):
    """Two hidden layers (128, 64) over the position one-hot."""

    def prepare(self, texts):
        x = one_hot(encode(texts))
        return x.reshape(len(x), -1)

    def start(self, x, rng):
        return _head_start({"w0": _dense(rng, x.shape[1], 128), "b0": np.zeros(128)}, rng, 128, 64)

    def forward(self, a, x):
        g = np.maximum(0, x @ a["w0"] + a["b0"])
        out, h = _head(a, g)
        return out, (x, g, h)

    def backward(self, a, kept, slope):
        x, g, h = kept
        slopes, dg = _head_back(a, g, h, slope)
        dg = dg * (g > 0)
        return slopes | {"w0": x.T @ dg, "b0": dg.sum(axis=0)}


class KmerMlp(PositionMlp):
    """The same layers over standardised k-mer shares."""

    def prepare(self, texts):
        x = kmer_matrix(encode(texts))
        if "standard" not in self.options:
            s = Standard(x)
            self.options["standard"] = [s.mean.tolist(), s.scale.tolist()]
        mean, scale = (np.asarray(v) for v in self.options["standard"])
        return (x - mean) / scale


class MotifCnn(Network):
    """One-dimensional filters, ReLU, mean pools over equal bins of positions, one hidden layer.

    ``options``: ``filters`` (window to number of filters) and ``bins``.  One window of 7 is
    the plain form; windows 5, 7 and 9 with 24 filters each the multi-scale form.
    """

    def _filters(self) -> list[tuple[int, int]]:
        return [tuple(map(int, p)) for p in self.options.setdefault("filters", [(7, 32)])]

    def _bins(self) -> int:
        return int(self.options.setdefault("bins", 5))

    def start(self, x, rng):
        arrays: Arrays = {}
        for w, n in self._filters():
            arrays |= {f"f{w}": _dense(rng, w * 4, n), f"c{w}": np.zeros(n)}
        return _head_start(arrays, rng, sum(n for _, n in self._filters()) * self._bins(), 64)

    def activations(self, a: Arrays, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the input and the filters' responses to them, before the ReLU."""
        view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * 4)
        return view, view @ a[f"f{w}"] + a[f"c{w}"]

    def forward(self, a, x):
        pooled, kept = [], []
        for w, _ in self._filters():
            view, z = self.activations(a, x, w)
            cuts = np.linspace(0, z.shape[1], self._bins() + 1).astype(int)
            r = np.maximum(0, z)
            pooled += [r[:, i:j].mean(axis=1) if j > i else np.zeros((len(r), r.shape[2])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            kept.append((view, z > 0, cuts))
        flat = np.concatenate(pooled, axis=1)
        out, h = _head(a, flat)
        return out, (flat, h, kept)

    def backward(self, a, kept, slope):
        flat, h, layers = kept
        slopes, dflat = _head_back(a, flat, h, slope)
        at = 0
        for (w, n), (view, on, cuts) in zip(self._filters(), layers, strict=True):
            dz = np.zeros(on.shape)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    dz[:, i:j] = dflat[:, None, at : at + n] / (j - i)
                at += n
            dz *= on
            slopes |= {f"f{w}": np.tensordot(view, dz, axes=([0, 1], [0, 1])), f"c{w}": dz.sum(axis=(0, 1))}
        return slopes

    def top_windows(self, texts: list[str], window: int, number: int, most: int = 100) -> list[str]:
        """The substrings that excite a filter most: rising activation is ranked falling, ties by row and place."""
        codes = encode(texts)
        _, z = self.activations(self.arrays, one_hot(codes), window)
        z = z[:, :, number]
        order = np.lexsort((np.tile(np.arange(z.shape[1]), len(z)), np.repeat(np.arange(len(z)), z.shape[1]), -z.ravel()))[:most]
        return ["".join(BASES[c] for c in codes[i // z.shape[1], i % z.shape[1] : i % z.shape[1] + window]) for i in order]


def excited_windows(rows, model: MotifCnn, window: int, filters: int, most: int = 100):
    """``(filter, place, sequence)``: the windows of all rows that excite each filter most, from ``place`` 0.

    Activations are ranked falling, ties by row and position.  Tasks hand on ``most`` windows
    a filter, so nothing but those is ranked over all rows.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from helixframe.shipping import arrow_map

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=object)) for _ in range(filters)]
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, keys = batch.column("sequence").to_pylist(), batch.column("sample_index").to_numpy()
            _, z = own.activations(own.arrays, one_hot(encode(texts)), window)
            wide = z.shape[1]
            row, at = np.repeat(np.arange(len(texts)), wide), np.tile(np.arange(wide), len(texts))
            for f in range(filters):
                a = z[:, :, f].ravel()
                top = np.lexsort((at, keys[row], -a))[:most]
                cut = np.array([texts[i][j : j + window] for i, j in zip(row[top], at[top], strict=True)], dtype=object)
                joined = [np.concatenate(pair) for pair in zip(best[f], (a[top], keys[row[top]], at[top], cut), strict=True)]
                order = np.lexsort((joined[2], joined[1], -joined[0]))[:most]
                best[f] = tuple(v[order] for v in joined)
        for f, (a, key, at, cut) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(a), pa.int32()), pa.array(a), pa.array(key), pa.array(at), pa.array(cut.tolist(), pa.string())], names=["filter", "activation", "sample_index", "at", "sequence"])

    found = arrow_map(rows.select("sample_index", "sequence"), run, "filter int, activation double, sample_index long, at long, sequence string")
    order = Window.partitionBy("filter").orderBy(F.col("activation").desc(), "sample_index", "at")
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most).select("filter", "place", "sequence")


def multiscale_cnn() -> MotifCnn:
    return MotifCnn(options={"filters": [(5, 24), (7, 24), (9, 24)], "bins": 5})


class Recurrent(Network):
    """Tanh recurrence over the bases; the last state feeds one hidden layer."""

    width = 24

    def start(self, x, rng):
        n = self.width
        return _head_start({"wx": rng.normal(scale=0.3, size=(4, n)), "wh": np.linalg.qr(rng.normal(size=(n, n)))[0] * 0.9, "bh": np.zeros(n)}, rng, n, 32)

    def forward(self, a, x):
        states = [np.zeros((len(x), self.width))]
        for t in range(x.shape[1]):
            states.append(np.tanh(x[:, t] @ a["wx"] + states[-1] @ a["wh"] + a["bh"]))
        out, h = _head(a, states[-1])
        return out, (x, states, h)

    def backward(self, a, kept, slope):
        x, states, h = kept
        slopes, d = _head_back(a, states[-1], h, slope)
        wx, wh, bh = np.zeros_like(a["wx"]), np.zeros_like(a["wh"]), np.zeros_like(a["bh"])
        for t in range(x.shape[1] - 1, -1, -1):
            d = d * (1 - states[t + 1] ** 2)
            wx, wh, bh = wx + x[:, t].T @ d, wh + states[t].T @ d, bh + d.sum(axis=0)
            d = d @ a["wh"].T
        return slopes | {"wx": wx, "wh": wh, "bh": bh}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Gated(Network):
    """Gated recurrent unit over the bases: reset and update gates before the candidate state."""

    width = 24

    def start(self, x, rng):
        n = self.width
        arrays = {}
        for g in "zrc":
            arrays |= {f"x{g}": rng.normal(scale=0.3, size=(4, n)), f"h{g}": np.linalg.qr(rng.normal(size=(n, n)))[0] * 0.9, f"b{g}": np.zeros(n)}
        return _head_start(arrays, rng, n, 32)

    def forward(self, a, x):
        s, steps = np.zeros((len(x), self.width)), []
        for t in range(x.shape[1]):
            u = x[:, t]
            z, r = _sigmoid(u @ a["xz"] + s @ a["hz"] + a["bz"]), _sigmoid(u @ a["xr"] + s @ a["hr"] + a["br"])
            c = np.tanh(u @ a["xc"] + (r * s) @ a["hc"] + a["bc"])
            steps.append((u, s, z, r, c))
            s = (1 - z) * s + z * c
        out, h = _head(a, s)
        return out, (steps, s, h)

    def backward(self, a, kept, slope):
        steps, last, h = kept
        slopes, d = _head_back(a, last, h, slope)
        g = {k: np.zeros_like(a[k]) for k in a if k[0] in "xhb" and k[1] in "zrc"}
        for u, s, z, r, c in reversed(steps):
            dc = d * z * (1 - c * c)
            back = dc @ a["hc"].T
            dz, dr = d * (c - s) * z * (1 - z), back * s * r * (1 - r)
            for name, e, state in (("z", dz, s), ("r", dr, s), ("c", dc, r * s)):
                g[f"x{name}"] += u.T @ e
                g[f"h{name}"] += state.T @ e
                g[f"b{name}"] += e.sum(axis=0)
            d = d * (1 - z) + back * r + dz @ a["hz"].T + dr @ a["hr"].T
        return slopes | g


@dataclass
class Ensemble:
    """Equal mean of several predictors."""

    members: list

    def predict(self, texts: list[str]) -> np.ndarray:
        return np.mean([m.predict(texts) for m in self.members], axis=0)


# --------------------------------------------------------------------------- conditional autoencoder


@dataclass
class ConditionalVae:
    """Encoder and decoder of one hidden layer over the one-hot bases and a condition; normal latent."""

    arrays: Arrays = field(default_factory=dict)
    mean: float = 0.0
    scale: float = 1.0
    length: int = 50
    latent: int = 16
    hidden: int = 64
    beta: float = 0.1

    def _encode(self, a, x, c):
        h = np.tanh(np.concatenate([x, c], axis=1) @ a["e1"] + a["d1"])
        return h, h @ a["em"] + a["dm"], np.clip(h @ a["ev"] + a["dv"], -8, 4)

    def _decode(self, a, z, c):
        h = np.tanh(np.concatenate([z, c], axis=1) @ a["g1"] + a["k1"])
        logits = (h @ a["g2"] + a["k2"]).reshape(len(z), self.length, 4)
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return h, p / p.sum(axis=2, keepdims=True)

    def losses(self, a: Arrays, x: np.ndarray, c: np.ndarray, noise: np.ndarray) -> tuple[float, float, Arrays]:
        """Reconstruction and divergence a row, and the slopes of reconstruction + beta * divergence."""
        n = len(x)
        h, mu, lv = self._encode(a, x, c)
        s = np.exp(lv / 2)
        z = mu + s * noise
        g, p = self._decode(a, z, c)
        hot = x.reshape(n, self.length, 4)
        rec = float(-(hot * np.log(p + 1e-12)).sum() / n)
        kl = float((0.5 * (np.exp(lv) + mu * mu - 1 - lv)).sum() / n)
        dl = ((p - hot) / n).reshape(n, -1)
        dg = (dl @ a["g2"].T) * (1 - g * g)
        dz = (dg @ a["g1"].T)[:, : self.latent]
        dmu = dz + self.beta * mu / n
        raw = h @ a["ev"] + a["dv"]
        dlv = (dz * noise * s / 2 + self.beta * 0.5 * (np.exp(lv) - 1) / n) * ((raw > -8) & (raw < 4))
        dh = (dmu @ a["em"].T + dlv @ a["ev"].T) * (1 - h * h)
        inputs, codes = np.concatenate([x, c], axis=1), np.concatenate([z, c], axis=1)
        return rec, kl, {"g2": g.T @ dl, "k2": dl.sum(0), "g1": codes.T @ dg, "k1": dg.sum(0), "em": h.T @ dmu, "dm": dmu.sum(0), "ev": h.T @ dlv, "dv": dlv.sum(0), "e1": inputs.T @ dh, "d1": dh.sum(0)}

    def fit(self, texts, condition, validation=None, epochs: int = 20, batch: int = 128, rate: float = 1e-3, patience: int = 5, seed: int = 0):
        x = one_hot(encode(texts)).reshape(len(texts), -1)
        self.length = x.shape[1] // 4
        y = np.asarray(condition, dtype=np.float64)
        self.mean, self.scale = float(y.mean()), float(y.std()) or 1.0
        c, rng, n = ((y - self.mean) / self.scale)[:, None], np.random.default_rng(seed), self.hidden
        a = {"e1": _dense(rng, x.shape[1] + 1, n), "em": _dense(rng, n, self.latent) * 0.3, "ev": _dense(rng, n, self.latent) * 0.1, "g1": _dense(rng, self.latent + 1, n), "g2": _dense(rng, n, x.shape[1]) * 0.3}
        a |= {"d1": np.zeros(n), "dm": np.zeros(self.latent), "dv": np.zeros(self.latent), "k1": np.zeros(n), "k2": np.zeros(x.shape[1])}
        adam, best, least, waited = Adam(a, rate), None, np.inf, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                adam.step(a, clip_norm(self.losses(a, x[rows], c[rows], rng.normal(size=(len(rows), self.latent)))[2], 5.0))
            if validation is not None:
                vx = one_hot(encode(validation[0])).reshape(len(validation[0]), -1)
                vc = ((np.asarray(validation[1]) - self.mean) / self.scale)[:, None]
                rec, kl, _ = self.losses(a, vx, vc, np.zeros((len(vx), self.latent)))
                if rec + self.beta * kl < least - 1e-9:
                    best, least, waited = {k: v.copy() for k, v in a.items()}, rec + self.beta * kl, 0
                else:
                    waited += 1
                    if waited >= patience:
                        break
        self.arrays = best or a
        return self

    def draw(self, keys: list[int], conditions: list[float], seed: int) -> list[str]:
        """One string a key: its noise comes from (seed, key) alone, so rows can be drawn anywhere."""
        out = []
        for key, c in zip(keys, conditions, strict=True):
            rng = np.random.default_rng([seed, int(key)])
            _, p = self._decode(self.arrays, rng.normal(size=(1, self.latent)), np.array([[(c - self.mean) / self.scale]]))
            code = (rng.uniform(size=self.length)[:, None] >= np.cumsum(p[0], axis=1)[:, :3]).sum(axis=1)
            out.append("".join(BASES[i] for i in code))
        return out

    def save(self, path: str) -> None:
        np.savez(path, schema=np.array("conditional-vae"), mean=self.mean, scale=self.scale, sizes=np.array([self.length, self.latent, self.hidden]), beta=self.beta, **{f"w_{k}": v for k, v in self.arrays.items()})

    @classmethod
    def load(cls, path: str) -> ConditionalVae:
        with np.load(path, allow_pickle=False) as f:
            if str(f["schema"]) != "conditional-vae":
                raise ValueError(f"{path} holds a {f['schema']}")
            length, latent, hidden = (int(v) for v in f["sizes"])
            return cls({k[2:]: f[k] for k in f.files if k.startswith("w_")}, float(f["mean"]), float(f["scale"]), length, latent, hidden, float(f["beta"]))
