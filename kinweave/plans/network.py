"""A two-stage network: one small net per column pair, whose outputs feed a record net.

Weights live on the driver; every step sums gradients of all partitions, which
are computed in numpy over Arrow batches.  Scoring is one Arrow-batched pass.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.operators import metrics
from kinweave.operators.matches import unpack_split
from kinweave.operators.pairs import id_names, similarity_features, subsample_non_matches
from kinweave.plans.models import MatchingModel, compact
from kinweave.runtime import ship
from kinweave.spec import MatchSpec, feature_name


def warmup_cosine(step: int, peak: float, warmup: int, total: int, least_ratio: float = 0.1) -> float:
    """Learning rate: linear up to the peak, then half a cosine down to least_ratio x peak."""
    if step < warmup:
        return peak * (step + 1) / max(1, warmup)
    at = min(1.0, (step - warmup) / max(1, total - warmup))
    return peak * (least_ratio + (1 - least_ratio) * 0.5 * (1 + math.cos(math.pi * at)))


#: Step sizes that ``NetworkModel.measured_rate`` tries, each about three times the one before.
RATES = (0.001, 0.003, 0.01, 0.03, 0.1)


def layer_sizes(spec: MatchSpec, width_scale: int = 10, depth: int = 2, record_scale: int = 10, record_depth: int = 4) -> tuple[list[list[int]], list[int]]:
    """Layer widths of the field nets (inputs .. 1) and of the record net (fields .. 1), halving from the first."""

    def shrink(n_in: int, scale: int, deep: int) -> list[int]:
        out, w = [n_in], n_in * scale
        for _ in range(deep):
            out.append(max(2, w))
            w //= 2
        return [*out, 1]

    sizes = spec.association_sizes()
    return [shrink(n, width_scale, depth) for n in sizes], shrink(len(sizes), record_scale, record_depth)


def describe(spec: MatchSpec, **own) -> str:
    """The architecture as text."""
    fields, record = layer_sizes(spec, **own)
    lines = [f"{k}: {' > '.join(map(str, s))}" for k, s in zip(spec.to_dict(), fields)]
    return "\n".join([*lines, f"record: {' > '.join(map(str, record))}"])


def _init(sizes: list[int], rng) -> list[np.ndarray]:
    out = []
    for a, b in zip(sizes, sizes[1:]):
        out += [rng.normal(0, math.sqrt(2 / (a + b)), (a, b)), np.zeros(b)]
    return out


def _forward(layers: list[np.ndarray], x: np.ndarray, logistic: bool = True) -> list[np.ndarray]:
    """Activations of all layers; the last is logistic (record net) or linear (field nets)."""
    acts = [x]
    for k in range(0, len(layers), 2):
        z = acts[-1] @ layers[k] + layers[k + 1]
        if k + 2 < len(layers):
            z = np.where(z > 0, z, 0.05 * z)
        acts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if logistic and k + 2 == len(layers) else z)
    return acts


def _backward(layers: list[np.ndarray], acts: list[np.ndarray], grad: np.ndarray, logistic: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    out: list[np.ndarray] = [None] * len(layers)
    g = grad * acts[-1] * (1 - acts[-1]) if logistic else grad
    for k in range(len(layers) - 2, -1, -2):
        out[k], out[k + 1] = acts[k // 2].T @ g, g.sum(0)
        g = g @ layers[k].T
        if k:
            g = g * np.where(acts[k // 2] > 0, 1.0, 0.05)
    return out, g


def loss_gradient(name: str, y: np.ndarray, p: np.ndarray, sums: np.ndarray, alpha: float, gamma: float) -> np.ndarray:
    """d loss / d p per row: binary_crossentropy, focal (sums over rows), soft_f1 (needs the totals tp, fp, fn) or combined."""
    p = np.clip(p, 1e-7, 1 - 1e-7)
    if name == "binary_crossentropy":
        return (p - y) / (p * (1 - p)) / sums[3]
    if name == "combined":  # half and half; the losses add up, and so do their gradients
        return 0.5 * loss_gradient("soft_f1", y, p, sums, alpha, gamma) + 0.5 * loss_gradient("focal", y, p, sums, alpha, gamma)
    if name == "focal":
        pt, at, sign = np.where(y == 1, p, 1 - p), np.where(y == 1, alpha, 1 - alpha), np.where(y == 1, 1.0, -1.0)
        return sign * at * (gamma * (1 - pt) ** (gamma - 1) * np.log(pt) - (1 - pt) ** gamma / pt) / sums[3]
    tp, fp, fn = sums[0], sums[1], sums[2]
    top, bottom = 2 * tp + 1e-7, 2 * tp + fp + fn + 1e-7
    d_tp, d_other = -2 / bottom + 2 * top / bottom**2, top / bottom**2
    return np.where(y == 1, d_tp - d_other, d_other)


class NetworkModel(MatchingModel):
    kind = "network"

    def __init__(self, spec, width_scale: int = 10, depth: int = 2, record_scale: int = 10, record_depth: int = 4, seed: int = 42):
        super().__init__()
        self.spec = MatchSpec.of(spec)
        self.shape = {"width_scale": width_scale, "depth": depth, "record_scale": record_scale, "record_depth": record_depth}
        rng = np.random.default_rng(seed)
        fields, record = layer_sizes(self.spec, **self.shape)
        self.nets = [*[_init(s, rng) for s in fields], _init(record, rng)]
        self.features, self.history = self.spec.features, []
        self.groups = []
        for key, names in self.spec.to_dict().items():
            a, b = key.split("~")[0], key.split("~")[-1]
            self.groups.append([self.features.index(feature_name(a, b, s)) for s in names])

    @property
    def parameters(self) -> int:
        return sum(w.size for net in self.nets for w in net)

    @staticmethod
    def _run(nets, groups, x):
        acts = [_forward(net, 2 * x[:, g] - 1, False) for net, g in zip(nets, groups)]
        return acts, _forward(nets[-1], np.concatenate([a[-1] for a in acts], axis=1))

    def _totals(self, data: DataFrame) -> np.ndarray:
        """tp, fp, fn and rows of the current weights: the soft counts that a loss over all rows needs."""
        p = self.predict(data)
        y = F.col("label")
        r = p.agg(F.sum(y * F.col("prediction")), F.sum((1 - y) * F.col("prediction")), F.sum(y * (1 - F.col("prediction"))), F.count(F.lit(1))).first()
        return np.array([float(v or 0) for v in r])

    def _gradient(self, data: DataFrame, loss: str | Callable, alpha: float, gamma: float) -> np.ndarray:
        """The gradient over all rows, one number a weight: every partition sums its own, the sums are added up."""
        nets, groups, sums, run, n_f = self.nets, self.groups, self._totals(data), self._run, len(self.features)

        def grads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [[np.zeros_like(w) for w in net] for net in nets]
            for b in batches:
                x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_f)], 1)
                y = b.column(n_f).to_numpy(zero_copy_only=False)[:, None]
                acts, top = run(nets, groups, x)
                slope = loss(y, top[-1], sums) if callable(loss) else loss_gradient(loss, y, top[-1], sums, alpha, gamma)
                g_rec, back = _backward(nets[-1], top, slope)
                for w, g in zip(total[-1], g_rec):
                    w += g
                for k, a in enumerate(acts):
                    g_f, _ = _backward(nets[k], a, back[:, [k]], False)
                    for w, g in zip(total[k], g_f):
                        w += g
            flat = np.concatenate([w.ravel() for net in total for w in net])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        rows = data.mapInArrow(grads, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # as many rows as parameters
        flat = np.zeros(self.parameters)
        for r in rows:
            flat[r["i"]] = r["g"]
        return flat

    def _moved(self, by: np.ndarray) -> list:
        at, out = 0, []
        for net in self.nets:
            out.append([])
            for w in net:
                out[-1].append(w - by[at : at + w.size].reshape(w.shape))
                at += w.size
        return out

    def measured_rate(self, data: DataFrame, loss: str | Callable = "soft_f1", alpha: float = 0.95, gamma: float = 1.5) -> float:
        """The step size of RATES after which one step by the sign of the gradient (what Adam's first step is) leaves the
        highest soft F1 on the rows themselves; of equal ones the smallest."""
        way, before, best = np.sign(self._gradient(data, loss, alpha, gamma)), self.nets, (-1.0, RATES[0])
        for rate in RATES:
            self.nets = self._moved(rate * way)
            tp, fp, fn, _ = self._totals(data)
            best = max(best, (round(2 * tp / max(2 * tp + fp + fn, 1e-12), 6), rate), key=lambda x: (x[0], -x[1]))
            self.nets = before
        return best[1]

    def fit(self, df: DataFrame, match_col: str = "match", epochs: int = 20, peak: float | None = 0.02, loss: str | Callable = "soft_f1", alpha: float = 0.95, gamma: float = 1.5, weight_decay: float | None = 1e-4, warmup: int = 3, checkpoints: str | None = None) -> NetworkModel:
        """Full-batch AdamW; keeps the weights of the epoch with the best F1 (the first of equals).

        With ``checkpoints`` the model of every epoch is written to checkpoints/epoch_NN.
        ``peak`` None measures the step size first (``measured_rate``);
        ``weight_decay`` None takes away a thousandth of every weight over all epochs.
        A loss of one's own is a function (y, p, totals) giving d loss / d p per row,
        where totals are the soft tp, fp, fn and the rows.
        """
        if not callable(loss) and loss not in ("soft_f1", "binary_crossentropy", "focal", "combined"):
            raise ValueError("loss must be soft_f1, binary_crossentropy, focal, combined or a function")
        ship(df.sparkSession)
        data = metrics.clean_features(df, self.features).select(*self.features, F.coalesce(F.col(match_col).cast("double"), F.lit(0.0)).alias("label"))
        data = compact(data)
        m = [[np.zeros_like(w) for w in net] for net in self.nets]
        v = [[np.zeros_like(w) for w in net] for net in self.nets]
        best, kept = -1.0, None
        peak = self.measured_rate(data, loss, alpha, gamma) if peak is None else peak
        weight_decay = 1e-3 / (peak * max(1, epochs)) if weight_decay is None else weight_decay
        try:
            for epoch in range(epochs):
                flat = self._gradient(data, loss, alpha, gamma)
                norm = float(np.linalg.norm(flat))
                flat = flat / max(1.0, norm)
                rate, at = warmup_cosine(epoch, peak, warmup, epochs), 0
                for k, net in enumerate(self.nets):
                    for j, w in enumerate(net):
                        g = flat[at : at + w.size].reshape(w.shape)
                        at += w.size
                        m[k][j] = 0.9 * m[k][j] + 0.1 * g
                        v[k][j] = 0.999 * v[k][j] + 0.001 * g * g
                        step = (m[k][j] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v[k][j] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
                        net[j] = w - rate * (step + weight_decay * w)
                f1 = metrics.evaluate(self.predict(data), 0.5, "label")["F1"]
                self.history.append({"f1": f1, "rate": rate})
                if checkpoints:
                    self.save(checkpoints, f"epoch_{epoch + 1:02d}")
                if f1 > best:
                    best, kept = f1, [[w.copy() for w in net] for net in self.nets]
            if kept is not None:
                self.nets = kept
        finally:
            data.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        nets, groups, run = self.nets, self.groups, self._run

        @F.pandas_udf("double")
        def score(*cols):
            import pandas as pd

            x = np.stack([np.asarray(c, dtype=float) for c in cols], 1)
            return pd.Series(run(nets, groups, x)[1][-1][:, 0])

        return metrics.clean_features(df, self.features).withColumn("prediction", score(*self.features))

    def save(self, target: str, name: str, spec=None, overwrite: bool = True) -> str:
        path = super().save(target, name, spec, overwrite)
        with open(f"{path}/network.json", "w") as f:
            json.dump(self.shape, f)
        np.savez(f"{path}/weights.npz", **{f"{k}-{j}": w for k, net in enumerate(self.nets) for j, w in enumerate(net)})
        return path


def train_network(
    spec, train, test, *, left_id: str = "id", right_id: str = "id", block_on=None, sims=None, stage1_loss: str = "soft_f1", epochs_1: int = 20, mismatch_share_1: float = 0.01, peak_1: float = 0.05,
    epochs_2: int = 10, mismatch_share_2: float = 0.1, peak_2: float = 0.01, gamma: float = 2.0, max_alpha: float = 0.9, stage_1: bool = True, stage_2: bool = True, base_dir: str | None = None, name: str = "network", seed: int = 42, **shape,
) -> tuple[NetworkModel, dict, dict]:
    """(model, measures on train, measures on test) of a network trained in two stages.

    First on few negatives with ``stage1_loss``, then on more with a focal loss
    whose alpha balances the classes (at most ``max_alpha``); each stage keeps
    its best epoch.  Both measures are taken on all pairs.
    """
    if not (stage_1 or stage_2):
        raise ValueError("at least one stage must run")
    model, keys = NetworkModel(spec, seed=seed, **shape), list(id_names(left_id, right_id))
    pairs = [similarity_features(s.left, s.right, s.matches, model.spec, left_id, right_id, block_on=block_on, sims=sims).persist() for s in map(unpack_split, (train, test))]
    s = unpack_split(train)
    steps = []
    if stage_1:
        steps.append((stage1_loss, epochs_1, mismatch_share_1, peak_1, 0.5))
    if stage_2:
        steps.append(("focal", epochs_2, mismatch_share_2, peak_2, metrics.alpha_balanced(s.left.count(), s.right.count(), s.matches.count(), mismatch_share_2, max_alpha)))
    try:
        for k, (loss, epochs, share, peak, alpha) in enumerate(steps, 1):
            model.fit(subsample_non_matches(pairs[0], keys, share, seed), epochs=epochs, peak=peak, loss=loss, alpha=alpha, gamma=gamma, warmup=max(1, epochs // 10), checkpoints=f"{base_dir}/{name}/stage_{k}" if base_dir else None)
        if base_dir:
            model.save(base_dir, name)
        return model, model.evaluate(pairs[0]), model.evaluate(pairs[1])
    finally:
        for p in pairs:
            p.unpersist()


def load_network(path: str) -> NetworkModel:
    with open(os.path.join(path, "network.json")) as f:
        shape = json.load(f)
    with open(os.path.join(path, "meta.json")) as f:
        meta = json.load(f)
    m = NetworkModel(MatchSpec.of(meta["similarity_map"]), **shape)
    m.best_threshold = meta["best_threshold"]
    with np.load(os.path.join(path, "weights.npz")) as w:
        m.nets = [[w[f"{k}-{j}"] for j in range(len(net))] for k, net in enumerate(m.nets)]
    return m
