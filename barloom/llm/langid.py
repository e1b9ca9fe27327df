"""Language identification by a bidirectional gated recurrent network over bytes, trained here by backpropagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, held_out, with_columns

HIDDEN = 8
#: Bytes that the recurrences run over at a time; longer texts are whole sequences of such stretches.
STRETCH = 128
LANES = 2048
#: Bound of the labelled rows that the network is trained on, and the bytes of the stretch taken from each.
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 64
STEPS = 260
BATCH = 256
RATE = 0.02
UNKNOWN = "und"


def _hard(x: np.ndarray) -> np.ndarray:
    """Piecewise linear gate between 0 and 1, in place."""
    x *= 0.25
    x += 0.5
    np.maximum(x, 0, out=x)
    return np.minimum(x, 1, out=x)


class Direction:
    """One gated recurrent layer: byte table (256, 3H) for update, reset and candidate, and recurrent weights (H, 3H)."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype("f4")
        self.inner = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype("f4")

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """States (T, B, H) for bytes x (T, B); a dead position passes a zero state on. With `keep`, what backward needs."""
        h = np.zeros((x.shape[1], HIDDEN), "f4")
        out, kept = np.empty((*x.shape, HIDDEN), "f4"), []
        for t in range(len(x)):
            a = self.table[x[t]]
            g = h @ self.inner
            gates = _hard(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = g[:, 2 * HIDDEN :] * r
            n += a[:, 2 * HIDDEN :]
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            if keep:
                kept.append((h, gates, n, g[:, 2 * HIDDEN :]))
            h = h - n
            h *= z
            h += n
            h *= live[t][:, None]
            out[t] = h
        return (out, kept) if keep else out

    def backward(self, x: np.ndarray, live: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of table and inner, given those of the states."""
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        dh = np.zeros_like(d_out[0])
        for t in reversed(range(len(x))):
            h, gates, n, inner_n = kept[t]
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            dh = (dh + d_out[t]) * live[t][:, None]
            dn = dh * (1 - z) * (np.abs(n) < 1)
            d_gates = np.concatenate([dh * (h - n), dn * inner_n], axis=1) * (0.25 * ((gates > 0) & (gates < 1)))
            d_g = np.concatenate([d_gates, dn * r], axis=1)
            np.add.at(d_table, x[t], np.concatenate([d_gates, dn], axis=1))
            d_inner += h.T @ d_g
            dh = dh * z + d_g @ self.inner.T
        return [d_table, d_inner]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Network:
    """Both directions, and a label for every position from their joined states."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(langs))).astype("f4")
        self.bias = np.zeros(len(langs), "f4")

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.inner, self.back.table, self.back.inner, self.out, self.bias]

    def positions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Label probabilities (T, B, languages) of every position."""
        states = np.concatenate([self.ahead.forward(x, live), self.back.forward(x[::-1], live[::-1])[::-1]], axis=2)
        scores = states.reshape(-1, 2 * HIDDEN) @ self.out + self.bias
        np.exp(scores, out=scores)  # states lie within -1 and 1, so scores stay small
        scores /= scores @ np.ones((scores.shape[1], 1), "f4")
        return scores.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over live positions, by backpropagation through time."""
        a, kept_a = self.ahead.forward(x, live, keep=True)
        b, kept_b = self.back.forward(x[::-1], live[::-1], keep=True)
        states = np.concatenate([a, b[::-1]], axis=2)
        d = _softmax(states @ self.out + self.bias)
        d[:, np.arange(len(y)), y] -= 1
        d *= (live / live.sum())[:, :, None]
        flat, d_flat = states.reshape(-1, 2 * HIDDEN), d.reshape(-1, d.shape[2])
        d_states = d @ self.out.T
        ahead = self.ahead.backward(x, live, kept_a, d_states[:, :, :HIDDEN])
        back = self.back.backward(x[::-1], live[::-1], kept_b, d_states[::-1, :, HIDDEN:])
        return [*ahead, *back, flat.T @ d_flat, d_flat.sum(axis=0)]

    def train(self, texts: list[bytes], labels: list[int]) -> None:
        """Adam over batches of stretches; some are cut short, as short texts must be told apart too."""
        rng = np.random.default_rng(11)
        size = SAMPLE_BYTES
        x = np.zeros((size, len(texts)), np.uint8)
        lengths = np.array([min(size, len(t)) for t in texts])
        for k, t in enumerate(texts):
            x[: lengths[k], k] = np.frombuffer(t[:size], np.uint8)
        y = np.array(labels)
        weights = self.weights()
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(texts), BATCH)
            cut = np.where(rng.random(BATCH) < 0.5, rng.integers(4, size + 1, BATCH), size)
            live = (np.arange(size)[:, None] < np.minimum(lengths[rows], cut)[None, :]).astype("f4")
            if not live.any():
                continue
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
            for w, g, mk, vk in zip(weights, self.gradients(x[:, rows], live, y[rows]), m, v, strict=True):
                mk += 0.1 * (g - mk)
                vk += 0.01 * (g * g - vk)
                w -= rate * (mk / (1 - 0.9**step)) / (np.sqrt(vk / (1 - 0.99**step)) + 1e-8)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text (zeros for an empty one)."""
        sums = np.zeros((len(texts), len(self.langs)))
        spans = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), STRETCH)]
        spans.sort(key=lambda s: min(STRETCH, len(texts[s[0]]) - s[1]))
        for first in range(0, len(spans), LANES):
            lane = spans[first : first + LANES]
            parts = [texts[k][at : at + STRETCH] for k, at in lane]
            long = max(map(len, parts))
            x = np.frombuffer(b"".join(p.ljust(long, b"\0") for p in parts), np.uint8).reshape(len(parts), long).T
            live = (np.arange(long)[:, None] < np.array(list(map(len, parts)))[None, :]).astype("f4")
            p = np.einsum("tbl,tb->bl", self.positions(np.ascontiguousarray(x), live), live)
            np.add.at(sums, [k for k, _ in lane], p)
        return sums / np.maximum(1, np.array(list(map(len, texts))))[:, None]


def sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> list:
    """At most `SAMPLE_ROWS` labelled rows that are not held out, spread by a hash; of each a stretch at a hashed place.

    Rows are counted first, and only those with a hash in the lowest part, about four times the sample, go on to be
    ordered: what reaches the driver doesn't grow with the table.
    """
    body = F.encode(F.col(text), "UTF-8")
    place = F.pmod(F.xxhash64(F.col(text), F.lit(3)), F.greatest(F.lit(1), F.octet_length(text) - SAMPLE_BYTES + 1))
    rows = docs.filter(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    order = F.xxhash64(F.col(doc_id), F.col(text), F.lit(5))
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, rows.count()))
    rows = rows.filter(F.pmod(order, F.lit(2**31)) < int(share * 2**31))
    taken = rows.select(F.substring(body, place.cast("int") + 1, F.lit(SAMPLE_BYTES)).alias("part"), F.col(lang).alias("lang"), order.alias("o"))
    return taken.orderBy("o", "lang", "part").limit(SAMPLE_ROWS).collect()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    rows = sample(docs, text, lang, doc_id)
    if not rows:
        return None
    network = Network(sorted({r["lang"] for r in rows}))
    network.train([bytes(r["part"]) for r in rows], [network.langs.index(r["lang"]) for r in rows])
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row, from the whole text only.

    A null text, and one without a letter, is `und` with score 0; so is everything if nothing could be learned. Ties go to
    the first language in order. A text is run in stretches of `STRETCH` bytes and its positions' probabilities are
    averaged; memory is bounded by a batch. An empty table gives an empty one.
    """
    spread = docs.sparkSession.sparkContext.broadcast(network)

    def work(texts: list) -> list:
        model, langs, scores = spread.value, [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if model is not None and known:
            p = model.pooled([texts[k].encode("utf-8", "replace") for k in known])
            for k, best, row in zip(known, p.argmax(axis=1), p, strict=True):
                langs[k], scores[k] = model.langs[best], float(min(1.0, row[best]))
        return [langs, scores]

    made = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return with_columns(docs, text, [doc_id], made, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
