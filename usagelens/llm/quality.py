"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Each byte has a learned
embedding; learned filters run over each chunk and are max-pooled inside it. The chunks of a document
are combined by their largest and mean responses, and one logistic unit gives the probability of
label 1. Training uses a bounded sample of labelled rows and, of a long document, some of its chunks
a step; scoring always reads every chunk.

Edge cases: null and empty texts are one chunk of padding; without labelled rows the score is 0.5;
null labels are not learned from; repeated rows are scored each on their own; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512
OVERLAP = 64
WIDTH = 12
STRIDE = 4
EMBED = 8
FILTERS = 32
PAD = 256
SAMPLE_ROWS = 4000  # labelled rows that the network is fitted on, about
SAMPLE_CHARS = 20000  # of texts no longer than this
STEP_CHUNKS = 12  # chunks of a document that one training step reads
STEPS = 1000  # of training, whatever the number of rows
BATCH_DOCS = 32
SCORE_CHUNKS = 128  # chunks in one product when scoring
THRESHOLD = 0.3
SEED = 5


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def chunks(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) byte values; the last chunk is filled up with padding."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    out = np.full(n * step + OVERLAP, PAD, np.int16)
    out[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::step]


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "base": np.zeros(1, np.float32),
        }
        self.p["embed"][PAD] = 0

    def windows(self, bytes_: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED)"""
        e = self.p["embed"][bytes_]
        v = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE]
        return v.transpose(0, 1, 3, 2).reshape(len(e), -1, WIDTH * EMBED)

    def pooled(self, bytes_: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): the largest response in each chunk."""
        w = self.windows(bytes_)
        r = (w.reshape(-1, w.shape[2]) @ self.p["filters"]).reshape(len(w), -1, FILTERS).max(axis=1)
        return np.maximum(r + self.p["bias"], 0)

    def combine(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([top, mean], axis=-1) @ self.p["out"] + self.p["base"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A probability a text; memory is bounded by SCORE_CHUNKS and the longest text."""
        tops = np.zeros((len(texts), FILTERS), np.float32)
        sums = np.zeros((len(texts), FILTERS), np.float64)
        counts = np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if not held:
                return
            r, who = self.pooled(np.concatenate(held)), np.concatenate(owner)
            np.maximum.at(tops, who, r)
            np.add.at(sums, who, r)
            np.add.at(counts, who, 1)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            own = chunks(text)
            for at in range(0, len(own), SCORE_CHUNKS):
                part = own[at : at + SCORE_CHUNKS]
                held.append(part)
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= SCORE_CHUNKS:
                    flush()
        flush()
        mean = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
        return self.combine(tops, mean)

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradient of the log loss over documents given as chunks."""
        p = self.p
        sizes = np.array([len(d) for d in docs])
        edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        all_bytes = np.concatenate(docs)
        w = self.windows(all_bytes)
        r = (w.reshape(-1, w.shape[2]) @ p["filters"]).reshape(len(w), -1, FILTERS)
        place = r.argmax(axis=1)
        raw = np.take_along_axis(r, place[:, None], 1)[:, 0] + p["bias"]
        h = np.maximum(raw, 0)
        top = np.maximum.reduceat(h, edges)
        mean = np.add.reduceat(h, edges) / sizes[:, None]
        error = ((self.combine(top, mean) - labels) / len(docs)).astype(np.float32)
        features = np.concatenate([top, mean], axis=1)
        owner = np.repeat(np.arange(len(docs)), sizes)
        # Back through both kinds of pooling to the windows that won.
        share = (h == top[owner]).astype(np.float32)
        share /= np.maximum(1, np.add.reduceat(share, edges))[owner]
        back = error[:, None] * p["out"][None, :]
        dh = back[owner, :FILTERS] * share + back[owner, FILTERS:] / sizes[owner][:, None]
        dh = (dh * (raw > 0)).astype(np.float32)
        grad_filters = np.empty_like(p["filters"])
        grad_embed = np.zeros_like(p["embed"])
        rows = np.arange(len(w))
        for f in range(FILTERS):
            won = w[rows, place[:, f]]
            grad_filters[:, f] = won.T @ dh[:, f]
            at = place[:, f][:, None] * STRIDE + np.arange(WIDTH)
            d = dh[:, f][:, None, None] * p["filters"][:, f].reshape(WIDTH, EMBED)[None]
            np.add.at(grad_embed, all_bytes[rows[:, None], at], d)
        grad_embed[PAD] = 0
        return {
            "embed": grad_embed, "filters": grad_filters, "bias": dh.sum(axis=0),
            "out": features.T @ error, "base": np.array([error.sum()], np.float32),
        }


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit by Adam on whole documents, or on chunks drawn anew each time from long ones."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    cut = [chunks(t) for t in texts]
    rate = min(max(y.mean(), 0.01), 0.99)
    net.p["base"][0] = np.log(rate / (1 - rate))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        lr = 0.01 * (1 - step / steps) + 0.0005
        if not len(order):
            order = rng.permutation(len(cut))
        batch, order = order[:BATCH_DOCS], order[BATCH_DOCS:]
        docs = [
            cut[i] if len(cut[i]) <= STEP_CHUNKS else cut[i][np.sort(rng.choice(len(cut[i]), STEP_CHUNKS, False))]
            for i in batch
        ]
        for k, g in net.gradients(docs, y[batch]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """Learn from about ``sample_rows`` labelled rows that are not held out, chosen by hash."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    share = min(1.0, sample_rows / max(1, known.count()))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).select("doc_id", "text")
    rows = known.where(pick).join(short, "doc_id").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows]) if rows else None


def score_texts(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256).to_pylist()
                got = net.score(part) if net else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(got, pa.float64())], names=["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score_texts(docs, fit(docs, labels, **bounds))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
