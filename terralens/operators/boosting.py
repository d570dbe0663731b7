"""Boosted trees for several classes, and their Shapley values.

The model is fitted in one task on a sample of bounded size and is small; prediction
and attribution run over the whole table in batches. A tree is complete to its depth:
node i has the children 2i + 1 and 2i + 2, and a node that is not split sends every
row left, so rows are led down by arithmetic on arrays.
"""

from __future__ import annotations

import itertools
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.functions.conform import argmax, label_of
from terralens.schema import FEATURES, LEVELS

#: Rows a model is fitted on at most; of a larger table those of least hash.
MAX_ROWS = 50_000
DEPTH, BINS = 4, 256
_INNER, _LEAVES = (1 << DEPTH) - 1, 1 << DEPTH


class Boosted:
    """Trees of ``rounds`` rounds, one per class in each: arrays by tree (round-major)."""

    def __init__(self, features: tuple[str, ...], classes: int):
        self.features, self.classes = tuple(features), classes
        self.feature = np.zeros((0, _INNER), np.int16)  # -1: not split
        self.cut = np.zeros((0, _INNER))
        self.cover = np.zeros((0, _INNER + _LEAVES))  # weight of the training rows at each node
        self.leaf = np.zeros((0, _LEAVES))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes) sums of the leaves."""
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            f, cut, at = np.maximum(self.feature[t], 0), self.cut[t], np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > cut[at])
            out[:, t % self.classes] += self.leaf[t][at - _INNER]
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes, features) Shapley values of the margins, where a feature left
        out leads a row down both ways, by the share of the training rows."""
        out = np.zeros((len(x), self.classes, len(self.features) + 1))
        for t in range(len(self.leaf)):
            table, where, place = self._table(t)
            went = x[:, np.maximum(self.feature[t], 0)] > self.cut[t]
            phi = out[:, t % self.classes]
            for leaf in np.flatnonzero(place[:, 0] >= -1):
                kept = np.full(len(x), _LEAVES - 1)
                node = _INNER + leaf
                for _ in range(DEPTH):
                    right, node = node % 2 == 0, (node - 1) // 2
                    if where[leaf, node] >= 0:
                        kept &= ~((went[:, node] != right).astype(np.int64) << where[leaf, node])
                given = table[leaf][kept]
                for j in range(DEPTH):
                    if place[leaf, j] >= 0:
                        phi[:, place[leaf, j]] += given[:, j]
        return out[:, :, :-1]

    def _table(self, t: int):
        """Of tree t: what each leaf gives the features on its way for every pattern of
        conditions met; the pattern's bit of each node; the feature of each bit. A leaf
        that no row can reach has features of -2."""
        share, where = np.ones((_LEAVES, DEPTH)), np.full((_LEAVES, _INNER), -1)
        place = np.full((_LEAVES, DEPTH), -1)
        for leaf in range(_LEAVES):
            way, node = [], _INNER + leaf
            while node:
                way.append((node, (node - 1) // 2, node % 2 == 0))
                node = (node - 1) // 2
            bits: dict[int, int] = {}
            for child, parent, right in reversed(way):
                f = int(self.feature[t, parent])
                if f < 0:
                    if right:
                        place[leaf] = -2
                    continue
                bit = bits.setdefault(f, len(bits))
                where[leaf, parent], place[leaf, bit] = bit, f
                share[leaf, bit] *= self.cover[t, child] / max(self.cover[t, parent], 1e-300)
        # a bit without a feature has share one and is always met: it changes nothing
        met = np.array(list(itertools.product((0, 1), repeat=DEPTH)))[:, ::-1]  # (pattern, bit)
        table = np.zeros((_LEAVES, _LEAVES, DEPTH))
        for i in range(DEPTH):
            others = [j for j in range(DEPTH) if j != i]
            total = np.zeros((_LEAVES, _LEAVES))
            for size in range(DEPTH):
                weight = math.factorial(size) * math.factorial(DEPTH - size - 1) / math.factorial(DEPTH)
                for chosen in itertools.combinations(others, size):
                    part = np.full((_LEAVES, _LEAVES), weight)
                    for j in others:
                        part = part * (met[None, :, j] if j in chosen else share[:, None, j])
                    total += part
            table[:, :, i] = total * (met[None, :, i] - share[:, None, i]) * self.leaf[t][:, None]
        return table, where, place


def _bins(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers of every value, and the cuts between the bins of each feature."""
    cuts, out = [], np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="nearest"))
        cuts.append((values[:-1] + values[1:]) / 2)
        out[:, j] = np.searchsorted(cuts[j], x[:, j], "left")
    return out, cuts


def _grow(b, cuts, g, h, columns, ridge, least):
    """One tree on binned rows: (feature, cut, cover, leaf) arrays."""
    feature, cut = np.full(_INNER, -1, np.int16), np.full(_INNER, np.inf)
    at, width = np.zeros(len(b), np.int64), len(columns) * BINS
    flat = b[:, columns] + np.arange(len(columns)) * BINS
    for level in range(DEPTH):
        first, n = (1 << level) - 1, 1 << level
        where = ((at - first)[:, None] * width + flat).reshape(-1)
        gs = np.bincount(where, np.repeat(g, len(columns)), n * width).reshape(n, len(columns), BINS)
        hs = np.bincount(where, np.repeat(h, len(columns)), n * width).reshape(n, len(columns), BINS)
        gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(hl < least) | (ht - hl < least)] = -1
        best = gain.reshape(n, -1).argmax(axis=1)
        ok = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
        chosen, bin_ = np.array(columns)[best // BINS], best % BINS
        for i in np.flatnonzero(ok):
            feature[first + i], cut[first + i] = chosen[i], cuts[chosen[i]][bin_[i]]
        node = at - first
        at = 2 * at + 1 + (ok[node] & (b[np.arange(len(b)), chosen[node]] > bin_[node]))
    cover = np.zeros(_INNER + _LEAVES)
    cover[_INNER:] = np.bincount(at - _INNER, h, _LEAVES)
    for i in range(_INNER - 1, -1, -1):
        cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
    return feature, cut, cover, -np.bincount(at - _INNER, g, _LEAVES) / (cover[_INNER:] + ridge)


def fit(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], classes: int, rounds: int = 300, rate: float = 0.08, rows: float = 0.9, columns: float = 0.9, ridge: float = 1.0, least: float = 1.0, seed: int = 42) -> Boosted:
    """Softmax boosting: in each round one tree per class, on a part of the rows and of
    the features, against gradient and curvature of the round's beginning."""
    model = Boosted(features, classes)
    if not len(x):
        return model
    r = np.random.default_rng(seed)
    b, cuts = _bins(x)
    margin, truth, trees = np.zeros((len(x), classes)), np.eye(classes)[y], []
    take = max(1, int(columns * x.shape[1]))
    every = np.arange(len(x))
    for _ in range(rounds):
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            used = np.flatnonzero(r.random(len(x)) < rows)
            chosen = sorted(r.choice(x.shape[1], take, replace=False).tolist())
            g, h = p[used, c] - truth[used, c], np.maximum(2 * p[used, c] * (1 - p[used, c]), 1e-16)
            feature, cut, cover, leaf = _grow(b[used], cuts, g, h, chosen, ridge, least)
            trees.append((feature, cut, cover, rate * leaf))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[every, np.maximum(feature[at], 0)] > cut[at])
            margin[:, c] += trees[-1][3][at - _INNER]
    model.feature, model.cut, model.cover, model.leaf = (np.array(v) for v in zip(*trees, strict=True))
    return model


def train(df: DataFrame, key: str, features: tuple[str, ...] = FEATURES, label: str = "y", classes: int = len(LEVELS), seed: int = 42, **settings) -> Boosted:
    """Fit on the labelled rows, in one task; of more than MAX_ROWS on those with the
    least hash of the key. Null features count as 0; ``label`` is the class's number."""
    order = F.xxhash64(key, F.lit(seed))
    rows = df.filter(F.col(label).isNotNull()).select(order.alias("_o"), F.col(label).cast("int").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    sample = rows.orderBy("_o", "_y", *features).limit(MAX_ROWS).coalesce(1)

    def run(batches):
        got = pd.concat([*batches, pd.DataFrame(columns=["_o", "_y", *features])])
        got = got.sort_values(["_o", "_y", *features])
        model = fit(got[list(features)].to_numpy(float), got["_y"].to_numpy(int), features, classes, seed=seed, **settings)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # the model has a fixed number of nodes
    found = sample.mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else Boosted(features, classes)  # noqa: S301


def _batches(df: DataFrame, model: Boosted, one, schema: str, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            x = pdf[list(shared.value.features)].astype(float).fillna(0).to_numpy(float)
            yield one(shared.value, x, pdf)

    return df.select(*keep, *[c for c in model.features if c not in keep]).mapInPandas(run, schema)


def predict(model: Boosted, df: DataFrame, names: tuple[str, ...] = LEVELS) -> DataFrame:
    """With p (array of probabilities), riesgo_pred (label) and confianza (the largest)."""
    def one(m, x, pdf):
        margin = m.margins(x)
        p = np.exp(margin - margin.max(axis=1, keepdims=True)) if len(x) else margin
        p = p / p.sum(axis=1, keepdims=True) if len(x) else p
        return pdf.assign(p=list(p))

    out = _batches(df, model, one, df.schema.simpleString()[7:-1] + ",p:array<double>", df.columns)
    return out.withColumns({"riesgo_pred": label_of(argmax("p"), names), "confianza": F.array_max("p")})


def importances(model: Boosted, df: DataFrame) -> DataFrame:
    """(feature, importance), largest first: mean absolute Shapley value over rows and
    classes; all features, none negative."""
    def one(m, x, pdf):
        sums = np.abs(m.shapley(x)).sum(axis=(0, 1)) / m.classes
        return pd.DataFrame({"feature": list(m.features), "s": sums, "n": len(x)})

    parts = _batches(df, model, one, "feature string, s double, n long", [])
    mean = F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0))
    return parts.groupBy("feature").agg(mean.alias("importance")).orderBy(F.desc("importance"), "feature")


def attributions(model: Boosted, df: DataFrame, key: str, n: int = 4, names: tuple[str, ...] = LEVELS) -> DataFrame:
    """(key, riesgo_pred, place, feature, phi): the n features that weigh most, by
    absolute Shapley value, in the class that each row is put in."""
    def one(m, x, pdf):
        said = m.margins(x).argmax(axis=1) if len(x) else np.zeros(0, int)
        phi = m.shapley(x)[np.arange(len(x)), said]
        most = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :n]
        k = most.shape[1]
        return pd.DataFrame({
            key: np.repeat(pdf[key].to_numpy(), k), "riesgo_pred": np.repeat(np.array(names, object)[said], k), "place": np.tile(np.arange(1, k + 1), len(x)),
            "feature": np.array(m.features, object)[most.reshape(-1)], "phi": np.take_along_axis(phi, most, axis=1).reshape(-1),
        })

    kind = df.schema[key].dataType.simpleString()
    return _batches(df, model, one, f"{key} {kind}, riesgo_pred string, place int, feature string, phi double", [key])
