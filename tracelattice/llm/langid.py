"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction keeps a small state, updated per byte by update and reset gates. Both states together label every position.
A document's language has the highest mean log-probability over the positions of its letters; the softmax of the means is
its pooled probability. The network is trained by backpropagation through time on windows of a bounded sample of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.llm.common import id_remainder, map_rows, pieces

HIDDEN, WINDOW = 8, 64
PER_LABEL, WINDOWS = 400, 6
STEPS, BATCH, RATE = 260, 384, 0.02
UNKNOWN = "und"


class Network:
    """Parameters of both directions (byte table, recurrent weights, candidate bias) and of the output layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            name + side: value
            for side in "fb"
            for name, value in (("table", normal(256, 3 * hidden, scale=0.3)), ("u", normal(hidden, 3 * hidden, scale=hidden**-0.5)), ("c", normal(hidden, scale=0.01)))
        }
        self.p |= {"w": normal(2 * hidden, len(labels), scale=0.3), "b": np.zeros(len(labels), np.float32)}

    def states(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States at every position of windows x (positions first), read forwards or backwards; keep gathers what training needs."""
        table, u, c, n = self.p["table" + side], self.p["u" + side], self.p["c" + side], self.hidden
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            a, r = table[x[t]], h @ u
            g = np.tanh((a[:, : 2 * n] + r[:, : 2 * n]) * np.float32(0.5))
            g *= np.float32(0.5)
            g += np.float32(0.5)
            cand = r[:, 2 * n :] + c
            new = np.tanh(a[:, 2 * n :] + g[:, n:] * cand)
            if keep is not None:
                keep.append((t, h, g, cand, new))
            h = new + g[:, :n] * (h - new)
            out[t] = h
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of every label at every position of windows x (positions first)."""
        both = np.concatenate([self.states(x, "f"), self.states(x, "b")], axis=2)
        z = both @ self.p["w"] + self.p["b"]
        z -= z.max(axis=2, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows x with labels y, and its gradients through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, s, kept[s]) for s in "fb"], axis=2)
        z = both @ self.p["w"] + self.p["b"]
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        at = np.arange(x.shape[1])
        loss = float(-np.log(p[:, at, y] + 1e-12).mean())
        p[:, at, y] -= 1
        p /= p.shape[0] * p.shape[1]
        grad = {"w": np.einsum("tbh,tbk->hk", both, p), "b": p.sum((0, 1))}
        back, n = p @ self.p["w"].T, self.hidden
        for i, side in enumerate("fb"):
            u = self.p["u" + side]
            table, du, dc = np.zeros_like(self.p["table" + side]), np.zeros_like(u), np.zeros(n, np.float32)
            carry = np.zeros((x.shape[1], n), np.float32)
            for t, h, g, cand, new in reversed(kept[side]):
                d = back[t, :, i * n : (i + 1) * n] + carry
                update, reset = g[:, :n], g[:, n:]
                dnew = d * (1 - update) * (1 - new * new)
                dcand = dnew * reset
                da = np.concatenate([d * (h - new) * update * (1 - update), dnew * cand * reset * (1 - reset), dnew], axis=1)
                dr = np.concatenate([da[:, : 2 * n], dcand], axis=1)
                np.add.at(table, x[t], da)
                du += h.T @ dr
                dc += dcand.sum(0)
                carry = d * update + dr @ u.T
            grad |= {"table" + side: table, "u" + side: du, "c" + side: dc}
        return loss, grad


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0, hidden: int = HIDDEN) -> Network:
    """A network fitted to windows x (rows of bytes) with label numbers y by Adam with a falling rate; labels are drawn evenly."""
    net, rng = Network(labels, hidden, seed), np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(q) for k, q in net.p.items()}
    weight = 1 / np.bincount(y, minlength=len(labels))[y]
    chance = np.cumsum(weight / weight.sum())
    for step in range(1, steps + 1):
        pick = np.minimum(np.searchsorted(chance, rng.random(min(batch, 4 * len(x)))), len(x) - 1)
        _, grad = net.gradients(x[pick].T, y[pick])
        now = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] = (net.p[k] - now * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return net


def learned_rows() -> Column:
    """Rows to learn from: a known language, and crc32 of the id modulo 4 is not 2 (null ids may be learned from)."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(id_remainder(4), F.lit(0)) != 2)


def sample_windows(docs: DataFrame, per_label: int = PER_LABEL, windows: int = WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels from the `per_label` documents of smallest hash of every label, `windows` from each.

    Only those windows reach the driver: at most per_label * windows * labels of WINDOW bytes.
    """
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = docs.where(learned_rows()).select("lang", "text")
    # rows of small hash by label first, so that few reach the ranking
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # broadcast: one row per label, and the network holds its labels on the driver anyway
    few = rows.join(F.broadcast(counts), "lang").where(mark < F.lit(float(1 << 40)) * (1.5 * per_label + 200) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(mark, "text"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= per_label)

    def cut(c):
        out: dict[str, list] = {"lang": [], "window": []}
        for lang, text in zip(c["lang"], c["text"]):
            last = max(0, len(text) - WINDOW)
            for k in range(windows):
                at = last * k // max(windows - 1, 1)
                piece = text[at : at + WINDOW]
                if any(b > 127 or 65 <= b & 223 <= 90 for b in piece):
                    out["lang"].append(lang.decode())
                    out["window"].append(piece.ljust(WINDOW))
        return out

    got = map_rows(chosen.select("lang", "text"), cut, "lang string, window binary").orderBy("lang", "window").toArrow()
    langs = got.column("lang").to_pylist()
    labels = sorted(set(langs))
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return x, np.array([labels.index(v) for v in langs], np.int64), labels


def fit_language_model(docs: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> Network | None:
    """A network trained on the sample; None if no row can be learned from."""
    x, y, labels = sample_windows(docs, per_label)
    return train(x, y, labels, steps) if len(x) else None


def predict(net: Network, texts: list[bytes]) -> list[tuple[str, float]]:
    """Label and pooled probability of each whole text; UNKNOWN and 0 for one without a letter."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chunks = -(-sizes // WINDOW)
    total = np.zeros((len(texts), len(net.labels)))
    count = np.zeros(len(texts))
    owner = np.repeat(np.arange(len(texts)), chunks)
    joined = bytearray(b"".join(t.ljust(int(n) * WINDOW) for t, n in zip(texts, chunks)))
    x = np.frombuffer(joined, np.uint8).reshape(-1, WINDOW) if joined else np.zeros((0, WINDOW), np.uint8)
    for at in range(0, len(x), 4096):
        part = np.ascontiguousarray(x[at : at + 4096].T)
        letter = (part > 127) | (((part & 223) >= 65) & ((part & 223) <= 90))
        logs = (net.log_probabilities(part) * letter[:, :, None]).sum(0)
        np.add.at(total, owner[at : at + 4096], logs)
        np.add.at(count, owner[at : at + 4096], letter.sum(0))
    mean = total / np.maximum(count, 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True, initial=-1e9)) if len(net.labels) else mean
    p /= p.sum(1, keepdims=True)
    out = []
    for i, text in enumerate(texts):
        if count[i] and any(map(str.isalpha, text.decode())):
            k = int(p[i].argmax())
            out.append((net.labels[k], float(p[i, k])))
        else:
            out.append((UNKNOWN, 0.0))
    return out


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """The columns of `docs` with lang_pred and score (0 to 1); `docs` has a column text and none of these two names.

    Null texts and texts without a letter get `und` and 0, as do all texts without a network. Whole texts are read, however
    long; repeated rows give repeated results; an empty table gives an empty one.
    """
    kinds, types = {"bigint": "long"}, dict(docs.dtypes)
    ddl = ", ".join([*(f"{c} {kinds.get(k, k)}" for c, k in docs.dtypes), "lang_pred string", "score double"])

    def rows(c):
        texts = [t or b"" for t in c["text"]]
        got: list[tuple[str, float]] = []
        for lo, hi in pieces(texts, 1 << 19):
            got += predict(net, texts[lo:hi]) if net else [(UNKNOWN, 0.0)] * (hi - lo)
        plain = {k: [v.decode() if isinstance(v, bytes) and types[k] == "string" else v for v in vs] for k, vs in c.items()}
        return plain | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_rows(docs, rows, ddl)


def accepted(net: Network | None, least: float = 0.5) -> Column:
    """Whether the language of column text is told with at least `least`; false for `und`."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        every, out = [(t or "").encode() for t in texts], []
        for lo, hi in pieces(every, 1 << 19):
            out += [label != UNKNOWN and p >= least for label, p in predict(net, every[lo:hi])] if net else [False] * (hi - lo)
        return pd.Series(out, dtype=bool)

    return check(F.col("text"))
