"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole UTF-8 text. The responses are max-pooled inside overlapping
chunks that cover the text; a document is the mean and the maximum over its chunks per filter, and one
logistic unit combines them into a probability.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. The fit uses at most
``TRAIN_ROWS`` rows of each class (those of the smallest hash of doc_id) and ``TRAIN_CHUNKS`` chunks of each;
the share of the classes is counted over all training labels. Scoring reads every byte of every text and needs
no shuffle.

A null text counts as empty; empty texts get a score too. A null doc_id is never a training row and is not
held out. Null or other labels than 0 and 1 are not used; of repeated labels each counts. Without training
rows of both classes every score is the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

import math
import pickle
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import columns_of, drop_large_caches, map_batches

TRAIN_ROWS = 1_000                                      # labelled rows of each class, at most; of these every chunk is read
TILE = 512                                              # chunks whose responses are held at a time in training
FILTERS, WIDTH, BLOCK, CHUNK_BLOCKS = 16, 8, 64, 4      # a chunk is four blocks and shares one with the next
EPOCHS, BATCHES, BATCH, RATE, SEED = 6, 200, 64, 0.01, 7   # at least BATCHES steps where the sample is small
BUFFER = 1 << 20                                        # bytes scored at a time
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


class Network:
    """Parameters: filters (width, 256, filters), their bias, the weights of the last unit, its bias."""

    def __init__(self, filters: int = FILTERS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((WIDTH, 256, filters)) * 0.15).astype(np.float32)
        self.w[:, 0, :] = 0                             # padding
        self.c = np.zeros(filters, np.float32)
        self.u = (r.standard_normal(2 * filters) * 0.1).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.constant: float | None = None

    # training -------------------------------------------------------------------------------------
    def fit(self, chunks: np.ndarray, of: np.ndarray, y: np.ndarray, prior: float, epochs: int = EPOCHS) -> Network:
        """``chunks`` (n, bytes) with the document ``of`` each, sorted; labels ``y``.
        ``prior`` is the log odds to add, since the sample holds both classes about equally."""
        names = ("w", "c", "u", "b")
        m1, m2 = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        t = 0
        lows = np.searchsorted(of, np.arange(len(y) + 1))
        r = np.random.default_rng(SEED)
        for _ in range(max(epochs, -(-BATCHES * BATCH // len(y)))):
            order = r.permutation(len(y))
            for at in range(0, len(y), BATCH):
                docs = order[at:at + BATCH]
                rows = np.concatenate([np.arange(lows[d], lows[d + 1]) for d in docs])
                starts = np.cumsum([0, *(lows[d + 1] - lows[d] for d in docs[:-1])])
                g = self._gradients(chunks[rows], starts, y[docs])
                t += 1
                for n in names:
                    m1[n] += 0.1 * (g[n] - m1[n])
                    m2[n] += 0.001 * (g[n] ** 2 - m2[n])
                    step = m1[n] / (1 - 0.9 ** t) / (np.sqrt(m2[n] / (1 - 0.999 ** t)) + 1e-7)
                    setattr(self, n, (getattr(self, n) - RATE * step).astype(np.float32))
        self.b = self.b + np.float32(prior)
        return self

    def _gradients(self, x, starts, y):
        span = x.shape[1] - WIDTH + 1
        place, top = np.empty((len(x), len(self.c)), np.intp), np.empty((len(x), len(self.c)), np.float32)    # (chunks, filters)
        for lo in range(0, len(x), TILE):
            part = x[lo:lo + TILE]
            conv = self.w[0][part[:, :span]]
            for k in range(1, WIDTH):
                conv += self.w[k][part[:, k:k + span]]
            place[lo:lo + TILE] = conv.argmax(axis=1)
            top[lo:lo + TILE] = np.take_along_axis(conv, place[lo:lo + TILE, None, :], 1)[:, 0] + self.c
        a = np.maximum(top, 0)
        counts = np.diff([*starts, len(x)])
        mean, most = np.add.reduceat(a, starts) / counts[:, None], np.maximum.reduceat(a, starts)
        features = np.hstack([mean, most])
        p = 1 / (1 + np.exp(-np.clip(features @ self.u + self.b, -30, 30)))
        e = (p - y) / len(y)
        doc, n = np.repeat(np.arange(len(y)), counts), len(self.c)
        da = (e[:, None] * self.u[:n] / counts[:, None])[doc]
        da = (da + (e[:, None] * self.u[n:2 * n])[doc] * (a == most[doc])) * (top > 0)
        dw, cols = np.zeros_like(self.w), np.broadcast_to(np.arange(n), place.shape)
        for k in range(WIDTH):
            np.add.at(dw[k], (np.take_along_axis(x, place + k, 1), cols), da)
        dw[:, 0, :] = 0
        return {"w": dw + 1e-5 * self.w, "c": da.sum(0), "u": features.T @ e + 1e-4 * self.u, "b": e.sum(keepdims=True)}

    # scoring --------------------------------------------------------------------------------------
    def pairs(self) -> list[np.ndarray]:
        """Responses to two neighbouring bytes at once."""
        return [(self.w[k][:, None, :] + self.w[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def score(self, texts: list[bytes], pairs: list[np.ndarray]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        out: list[float] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= BUFFER):
                size += len(texts[end])
                end += 1
            # at least WIDTH - 1 bytes of padding, so no filter reaches from one text into the next
            blocks = [-(-(len(t) + WIDTH - 1) // BLOCK) for t in texts[at:end]]
            tops = self._block_tops(b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts[at:end], blocks)),
                                    np.cumsum(blocks) * BLOCK, pairs)
            low, features = 0, []
            for n in blocks:
                a = tops[low:low + n]
                low += n
                if n > CHUNK_BLOCKS:
                    first = np.arange(0, n - 1, CHUNK_BLOCKS - 1)
                    a = np.max([a[np.minimum(first + k, n - 1)] for k in range(CHUNK_BLOCKS)], axis=0)
                else:
                    a = a.max(axis=0, keepdims=True)
                features.append(np.concatenate((a.mean(axis=0), a.max(axis=0))))
            z = np.array(features) @ self.u + self.b
            out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).astype(float).tolist()
            at = end
        return out

    def _block_tops(self, data: bytes, ends: np.ndarray, pairs) -> np.ndarray:
        """Largest response of each filter among the places of each block. The last places before the ``ends`` of
        texts are padding whose filters would read on into the next text, so they do not count."""
        idle = (ends[:, None] - np.arange(WIDTH - 1, 0, -1)).ravel()
        x = np.frombuffer(data + b"\0" * WIDTH, np.uint8).astype(np.intp)
        two = (x[:-1] << 8) | x[1:]
        out = np.empty((len(data) // BLOCK, len(self.c)), np.float32)
        step = 256 * BLOCK
        for lo in range(0, len(data), step):
            n = min(step, len(data) - lo)
            conv = pairs[0].take(two[lo:lo + n], axis=0)
            for k, p in enumerate(pairs[1:], 1):
                conv += p.take(two[lo + 2 * k:lo + 2 * k + n], axis=0)
            conv[idle[np.searchsorted(idle, lo):np.searchsorted(idle, lo + n)] - lo] = -np.inf
            out[lo // BLOCK:(lo + n) // BLOCK] = conv.reshape(-1, BLOCK, len(self.c)).max(axis=1)
        return np.maximum(out + self.c, 0)


def _sample(text: str | None) -> list[bytes]:
    """All chunks of a text, each with the bytes its last filter reads."""
    raw, size, step = (text or "").encode("utf-8", "replace"), CHUNK_BLOCKS * BLOCK, (CHUNK_BLOCKS - 1) * BLOCK
    starts = list(range(0, max(1, len(raw) - BLOCK), step))
    return [raw[s:s + size + WIDTH - 1].ljust(size + WIDTH - 1, b"\0") for s in starts]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fit on a bounded sample of the labelled training rows: ``rows`` of each class, with their whole texts."""
    docs = columns_of(documents, "doc_id", "text")
    known = columns_of(labels, "doc_id", label).toDF("doc_id", "_y").filter("doc_id is not null and _y in (0, 1)") \
        .filter(~held_out())
    shares = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    net = Network()
    if len(shares) < 2:
        net.constant = float(next(iter(shares))) if shares else 0.5
        return net
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("_y = 0").orderBy(*order).limit(rows).union(known.filter("_y = 1").orderBy(*order).limit(rows))

    def cut(cols):
        return {"doc_id": cols["doc_id"], "_y": cols["_y"], "chunks": [_sample(t) for t in cols["text"]]}
    # bounded by 2 x rows rows of two numbers, so they may be broadcast
    joined = docs.join(F.broadcast(picked), "doc_id")
    sample = map_batches(joined, "doc_id bigint, _y int, chunks array<binary>", cut).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["_y"], r["chunks"]))
    y = np.array([r["_y"] for r in sample], np.float32)
    if not 0 < y.sum() < len(y):
        net.constant = shares[1] / (shares[0] + shares[1])
        return net
    chunks = np.array([np.frombuffer(c, np.uint8) for r in sample for c in r["chunks"]])
    of = np.repeat(np.arange(len(sample)), [len(r["chunks"]) for r in sample])
    prior = math.log(shares[1] / shares[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return net.fit(chunks, of, y, prior)


@lru_cache(maxsize=2)
def _loaded(raw: bytes) -> tuple[Network, list[np.ndarray]]:
    net = pickle.loads(raw)
    return net, net.pairs()


def quality_scores(documents: DataFrame, net: Network) -> DataFrame:
    """Score of every row of ``documents``: doc_id, held_out, score, predicted."""
    sent = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))     # 130 KB, fixed

    def rows(cols):
        model, pairs = _loaded(sent.value)
        p = model.score([(t or "").encode("utf-8", "replace") for t in cols["text"]], pairs)
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": p,
                "predicted": [int(x >= 0.5) for x in p]}
    docs = columns_of(documents, "doc_id", "text").withColumn("held_out", held_out())
    return map_batches(docs, SCHEMA, rows)


def keep_good(documents: DataFrame, net: Network) -> DataFrame:
    """Rows that the network accepts, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    schema = documents.schema

    def run(batches):
        drop_large_caches()
        model, pairs = _loaded(sent.value)
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            import pyarrow as pa
            yield b.filter(pa.array([x >= 0.5 for x in model.score(texts, pairs)], pa.bool_()))
    return documents.mapInArrow(run, schema)
