"""Feed-forward binary classifiers with dropout, trained data-parallel with early stopping.

In every epoch each task runs mini-batches over its rows from the same start, and the tasks' states, weighted by their
rows, are averaged (in two steps where there are many tasks) and sent out again. Several networks can be trained at a
time, so that an epoch of all of them is one pass over the table. Only network states reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z, a: 1.0 - a * a),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0.0))), lambda z, a: np.where(z > 0, 1.0, a + 1.0)),
}
PATIENCE = 10  # epochs without a lower validation loss
FAN = 32  # states that one task averages
BETA1, BETA2, TINY = 0.9, 0.999, 1e-7
DEFAULTS = {"units": [16], "dropout": [0.0], "activation": "relu", "weight_decay": 1e-4, "learning_rate": 1e-3,
            "batch_size": 32, "epochs": 100}


class Network:
    """Weights and optimiser state of one classifier, as flat vectors; the last layer gives one logit."""

    def __init__(self, params: dict, n_features: int, seed: int = 42) -> None:
        self.params = {**DEFAULTS, **params}
        self.sizes = [n_features, *self.params["units"], 1]
        draw = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            limit = np.sqrt(6.0 / (a + b))
            parts += [draw.uniform(-limit, limit, a * b), np.zeros(b)]
        self.theta = np.concatenate(parts)
        self.first, self.second, self.steps = np.zeros_like(self.theta), np.zeros_like(self.theta), 0.0

    def state(self) -> np.ndarray:
        return np.concatenate([self.theta, self.first, self.second, [self.steps]])

    def load(self, state: np.ndarray) -> Network:
        n = len(self.theta)
        own = np.array(state)  # training changes the vectors in place
        self.theta, self.first, self.second, self.steps = own[:n], own[n:2 * n], own[2 * n:3 * n], float(own[-1])
        return self

    def _layers(self, theta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            yield theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]
            at += a * b + b

    def logits(self, x: np.ndarray) -> np.ndarray:
        act, _ = ACTIVATIONS[self.params["activation"]]
        layers = list(self._layers(self.theta))
        for w, b in layers[:-1]:
            x = act(x @ w + b)
        w, b = layers[-1]
        return (x @ w + b)[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, draw: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Mean cross-entropy plus the weights' penalty, and its gradient; units are dropped if there is a ``draw``."""
        act, slope = ACTIVATIONS[self.params["activation"]]
        layers, decay = list(self._layers(self.theta)), self.params["weight_decay"]
        rates = list(self.params["dropout"]) + [0.0] * len(layers)
        inputs, sums, outs, masks, loss = [], [], [], [], 0.0
        for k, (w, b) in enumerate(layers[:-1]):
            inputs.append(x)
            z = x @ w + b
            a = act(z)
            keep = 1.0 - rates[k]
            mask = (draw.random(a.shape) < keep) / keep if draw is not None and keep < 1.0 else np.ones(1)
            sums.append(z), outs.append(a), masks.append(mask)
            x = a * mask
            loss += decay * float((w * w).sum())
        w, b = layers[-1]
        inputs.append(x)
        logit = (x @ w + b)[:, 0]
        loss += float(np.logaddexp(0.0, logit).mean() - (y * logit).mean())
        back = ((_sigmoid(logit) - y) / len(y))[:, None]
        parts = []
        for k in range(len(layers) - 1, -1, -1):
            w, _ = layers[k]
            own = inputs[k].T @ back
            if k < len(layers) - 1:
                own = own + 2 * decay * w
            parts = [own.ravel(), back.sum(axis=0), *parts]
            if k:
                back = (back @ w.T) * masks[k - 1] * slope(sums[k - 1], outs[k - 1])
        return loss, np.concatenate(parts)

    def train(self, x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> None:
        """One pass over the rows in a drawn order, by mini-batches with running moments of the gradient."""
        order, size = draw.permutation(len(y)), self.params["batch_size"]
        for at in range(0, len(order), size):
            part = order[at:at + size]
            _, g = self.gradient(x[part], y[part], draw)
            self.steps += 1
            self.first *= BETA1
            self.first += (1 - BETA1) * g
            self.second *= BETA2
            self.second += (1 - BETA2) * g * g
            step = self.params["learning_rate"] * np.sqrt(1 - BETA2 ** self.steps) / (1 - BETA1 ** self.steps)
            self.theta -= step * self.first / (np.sqrt(self.second) + TINY)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return _entropy(self.logits(x), y)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))

    def score(self, df: DataFrame, name: str = "predicted_proba", features: str = "features") -> DataFrame:
        """Adds the probability of class 1."""
        network = self

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            return pd.Series(network.probabilities(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

        return df.withColumn(name, probability(F.col(features).cast("array<double>")))


def _entropy(logit: np.ndarray, y: np.ndarray) -> float:
    """Summed cross-entropy."""
    return float(np.logaddexp(0.0, logit).sum() - (y * logit).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


class EarlyStop:
    """The state with the least validation loss so far, and whether ``PATIENCE`` epochs brought nothing better."""

    def __init__(self, patience: int = PATIENCE) -> None:
        self.patience, self.best, self.state, self.wait = patience, np.inf, None, 0

    def see(self, loss: float, state: np.ndarray) -> None:
        if loss < self.best:
            self.best, self.state, self.wait = loss, state, 0
        else:
            self.wait += 1

    @property
    def done(self) -> bool:
        return self.wait >= self.patience


def epoch_pass(rows: DataFrame, networks: dict[int, Network], is_train: Column, label: str, seed: int) -> dict[int, tuple]:
    """Number -> (averaged state, validation loss and F1 of the state that went in), in one pass over ``rows``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained = {i: Network(n.params, n.sizes[0]).load(n.state()) for i, n in networks.items()}
        draw, n_train, n_val, losses = np.random.default_rng(seed), 0, 0, dict.fromkeys(networks, 0.0)
        hits, said = dict.fromkeys(networks, 0), dict.fromkeys(networks, 0)  # said and true ones; F1 is twice their ratio
        for batch in batches:
            if not len(batch):
                continue
            x, y, used = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy(dtype=float), batch["train"].to_numpy(dtype=bool)
            for i, network in networks.items():
                if not used.all():
                    logit, true = network.logits(x[~used]), y[~used] == 1
                    losses[i] += _entropy(logit, y[~used])
                    hits[i] += int(((logit > 0) & true).sum())
                    said[i] += int((logit > 0).sum() + true.sum())
                if used.any():
                    trained[i].train(x[used], y[used], draw)
            n_train, n_val = n_train + int(used.sum()), n_val + int((~used).sum())
        if n_train + n_val:
            yield pd.DataFrame({"number": list(trained), "fan": int.from_bytes(draw.bytes(2), "big") % FAN,
                                "state": [t.state() * n_train for t in trained.values()], "n_train": n_train,
                                "loss": [losses[i] for i in trained], "n_val": n_val,
                                "hits": [hits[i] for i in trained], "said": [said[i] for i in trained]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {"number": [pdf["number"].iloc[0]], "fan": [0], "state": [np.sum(np.stack(pdf["state"].to_numpy()), axis=0)]}
        return pd.DataFrame(head | {c: [pdf[c].sum()] for c in ("n_train", "loss", "n_val", "hits", "said")})

    schema = "number int, fan int, state array<double>, n_train long, loss double, n_val long, hits long, said long"
    asked = rows.select(F.col("features").cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                        is_train.alias("train"))
    parts = asked.mapInPandas(run, schema)
    if rows.rdd.getNumPartitions() > FAN:
        parts = parts.groupBy("number", "fan").applyInPandas(add, schema)
    told = parts.groupBy("number").applyInPandas(add, schema).collect()  # a row per network
    return {r["number"]: (np.array(r["state"]) / r["n_train"] if r["n_train"] else networks[r["number"]].state(),
                          r["loss"] / max(r["n_val"], 1), 2 * r["hits"] / max(r["said"], 1)) for r in told}


def fit_networks(rows: DataFrame, label: str, candidates: list[dict], split: str = "split", train: str = "train",
                 validation: str = "val", seed: int = 42, patience: int = PATIENCE) -> list[Network]:
    """(features, label, split) -> the candidates' networks, each with the weights of its least validation loss.

    A network stops after its ``epochs`` or when its validation loss did not fall for ``patience`` epochs. Without
    validation rows it keeps its last weights. Rows of equal number in every partition are best; an empty train split
    leaves the first weights.
    """
    used = rows.where(F.col(split).isin(train, validation))
    first = used.select(F.size("features").alias("n")).first()
    networks = [Network(p, first["n"] if first else 1, seed) for p in candidates]
    stops = [EarlyStop(patience) for _ in networks]
    for epoch in range(max((n.params["epochs"] for n in networks), default=0) + 1):
        going = {i: n for i, n in enumerate(networks) if not stops[i].done and epoch <= n.params["epochs"]}
        if not going or first is None:
            break
        told = epoch_pass(used, going, F.col(split) == train, label, seed + epoch)
        for i, network in going.items():
            state, loss, _ = told.get(i, (network.state(), 0.0, 0.0))
            stops[i].see(loss if loss else -float(epoch), network.state())  # the loss is that of the state that went in
            if epoch < network.params["epochs"]:
                network.load(state)
    return [n.load(s.state) if s.state is not None else n for n, s in zip(networks, stops)]
