"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, with its two ends marked, each hashed to a row of an embedding table; a
passage is the average of its words' rows, and a linear softmax over that average gives the two classes. A misspelling
shares most n-grams with the word it comes from. Labels are of whole documents while toxic words are few, so training
goes in turns: score all passages of the training documents, take the one that looks worst from each document as what
its label is about, and train table and softmax on those and on further passages of clean documents. A document's
score is that of its worst passage.

Labels are learned on the driver from a bounded sample; scoring runs over every whole text, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample that labels are learned from: so many clean and toxic documents, of at most so many characters.
TRAIN_DOCS, TRAIN_CHARS = (3000, 1000), 20_000
BUCKETS_LOG2, DIMS, PASSAGE = 17, 8, 24
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
#: Bytes of text that one numpy pass takes; one longer text is a pass of its own.
PASS_BYTES = 1 << 20


@dataclass
class Passages:
    """Texts as bags: for each byte position its valid n-gram buckets; where words begin; where texts begin (in words)."""

    buckets: list[np.ndarray]
    valid: list[np.ndarray]
    starts: np.ndarray
    texts: np.ndarray
    size: int


def bags(texts: list[str]) -> Passages:
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(encoded) + b"     ", np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    size = len(raw) - 5
    codes = np.where(gap, np.uint8(32), raw).astype(np.uint32)
    h = codes[:size] * np.uint32(0x01000193) + codes[1 : size + 1]
    inner = np.ones(size, bool)
    buckets, valid = [], []
    for n in range(3, max(GRAMS) + 1):
        inner = inner & ~gap[n - 2 : size + n - 2]
        h = h * np.uint32(0x85EBCA6B) + codes[n - 1 : size + n - 1]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            buckets.append(mixed >> np.uint32(32 - BUCKETS_LOG2))
            valid.append(inner)
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])  # the gap before a word belongs to it
    ends = np.cumsum([len(e) + 1 for e in encoded])
    # a word like the one before it in its text counts once, so that no passage is one word over and over
    total = np.concatenate(([0], np.cumsum(np.where(gap[:size], np.uint32(0), h))))
    sums = np.diff(np.append(total[starts], total[-1]))
    lengths = np.add.reduceat(~gap[:size], starts) if len(starts) else starts
    again = np.zeros(len(starts), bool)
    again[1:] = (sums[1:] == sums[:-1]) & (lengths[1:] == lengths[:-1])
    firsts = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))
    again[firsts[firsts < len(starts)]] = False
    if again.any():
        skip = np.zeros(size + 1, np.int8)
        skip[starts[again]] += 1
        skip[np.append(starts, size)[1:][again]] -= 1
        keep = np.cumsum(skip[:size]) == 0
        valid = [v & keep for v in valid]
        starts = starts[~again]
    return Passages(buckets, valid, starts, np.concatenate(([0], np.searchsorted(starts, ends))), size)


def _prefix(per_position: np.ndarray, p: Passages) -> np.ndarray:
    """Sums before each word and after the last."""
    total = np.concatenate(([0.0], np.cumsum(per_position)))
    return np.append(total[p.starts], total[p.size])


def worst(p: Passages, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the largest mean weight of a passage of PASSAGE words (all words, if fewer), and its first word."""
    value = sum(np.where(v, weights[b], 0.0) for b, v in zip(p.buckets, p.valid, strict=True))
    sums = _prefix(value.astype(np.float64), p)
    counts = _prefix(sum(v.astype(np.float64) for v in p.valid), p)
    n = len(p.starts)
    best, at = np.zeros(len(p.texts) - 1), np.zeros(len(p.texts) - 1, np.int64)
    if not n:
        return best, at
    until = np.repeat(p.texts[1:], np.diff(p.texts))
    to = np.minimum(np.arange(n) + PASSAGE, until)
    mean = (sums[to] - sums[:-1]) / np.maximum(counts[to] - counts[:-1], 1.0)
    last = np.maximum(until - PASSAGE, np.repeat(p.texts[:-1], np.diff(p.texts)))
    mean = np.where(np.arange(n) <= last, mean, -np.inf)
    full = np.flatnonzero(np.diff(p.texts))
    best[full] = np.maximum.reduceat(mean, p.texts[full])
    hit = np.flatnonzero(mean == np.repeat(best, np.diff(p.texts)))
    of = np.searchsorted(p.texts, hit, side="right") - 1
    first = np.unique(of, return_index=True)[1]
    at[of[first]] = hit[first]
    return best, at


@dataclass
class Model:
    """weights: what a bucket adds to the logit before averaging, which is all that scoring needs of table and softmax."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) < PASS_BYTES:
                size += len(texts[to])
                to += 1
            out[at:to] = worst(bags(texts[at:to]), self.weights)[0]
            at = to
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -50, 50)))


def _bag(p: Passages, first: int, text_end: int) -> np.ndarray:
    a = p.starts[first]
    last = min(first + PASSAGE, text_end)
    b = p.starts[last] if last < len(p.starts) else p.size
    return np.concatenate([bucket[a:b][ok[a:b]] for bucket, ok in zip(p.buckets, p.valid, strict=True)]).astype(np.int64)


def train(texts: list[str], toxic: np.ndarray, seed: int = 11, turns: int = 5) -> Model:
    """Table and softmax by Adagrad on the cross-entropy. Without both classes: the share of toxic ones as every score."""
    toxic = np.asarray(toxic, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), 20.0 if len(toxic) and toxic[0] else -20.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (1 << BUCKETS_LOG2, DIMS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIMS, 2)), np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full(len(table), 1e-3, np.float32), np.full(soft.shape, 1e-3), np.full(2, 1e-3)
    parts = []
    for at in range(0, len(texts), 64):
        parts.append(bags(texts[at : at + 64]))
    for turn in range(turns):
        delta = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        samples, labels = [], []
        for k, p in enumerate(parts):
            _, at = worst(p, delta)
            for i, y in enumerate(toxic[64 * k : 64 * k + 64]):
                lo, hi = p.texts[i], p.texts[i + 1]
                if lo == hi:
                    continue
                if turn == 0:  # nothing is known yet: passages all over a document bear its label
                    picks = range(lo + int(rng.integers(PASSAGE)) % (hi - lo), hi, max(PASSAGE, (hi - lo) // 6))
                elif y:
                    picks = [at[i]]
                else:
                    picks = [at[i], *rng.integers(lo, hi, 2)]
                for w in picks:
                    samples.append(_bag(p, int(w), int(hi)))
                    labels.append(y)
        order, y = rng.permutation(len(samples)), np.array(labels)
        for _ in range(min(12, max(2, 16_000 // max(1, len(samples))))):  # few samples are seen more often
            for lo in range(0, len(order), 64):
                batch = [samples[i] for i in order[lo : lo + 64] if len(samples[i])]
                target = y[[i for i in order[lo : lo + 64] if len(samples[i])]]
                if not batch:
                    continue
                # dropping n-grams at random keeps one gram from standing for its word
                batch = [g[keep] if (keep := rng.random(len(g)) < 0.8).any() else g for g in batch]
                ids, size = np.concatenate(batch), np.array([len(g) for g in batch])
                of = np.repeat(np.arange(len(batch)), size)
                mean = np.add.reduceat(table[ids], np.cumsum(size) - size) / size[:, None]
                logit = mean @ soft + bias
                prob = np.exp(logit - logit.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(len(batch)), target] -= 1
                g_mean = (prob @ soft.T).astype(np.float32)
                g_soft, g_bias = mean.T @ prob / len(batch), prob.mean(0)
                seen_soft += g_soft**2
                seen_bias += g_bias**2
                soft -= 0.2 * g_soft / np.sqrt(seen_soft)
                bias -= 0.2 * g_bias / np.sqrt(seen_bias)
                rows, back = np.unique(ids, return_inverse=True)
                by_row = np.argsort(back, kind="stable")
                cuts = np.searchsorted(back[by_row], np.arange(len(rows)))
                g_rows = np.add.reduceat((g_mean / size[:, None].astype(np.float32))[of[by_row]], cuts)
                seen_table[rows] += (g_rows**2).sum(1)
                table[rows] -= 0.5 * g_rows / np.sqrt(seen_table[rows])[:, None]
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """A model from labels (doc_id, toxic) of rows that aren't held out; a null label is none. The sample is the
    TRAIN_DOCS documents of the two classes with the least hash of their id."""
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS[y])
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most the sum of TRAIN_DOCS rows
    sample = (
        docs.select("doc_id", "text")
        .filter(F.char_length("text") <= TRAIN_CHARS)
        .join(chosen, "doc_id")
        .orderBy("doc_id", "text", "toxic")
        .limit(sum(TRAIN_DOCS))
        .collect()
    )
    return train([r.text for r in sample], np.array([r.toxic for r in sample]), seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); null and empty texts get the softmax of
    an empty average. Repeated rows get equal scores; other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            scores = model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def crc_of(doc_id: int) -> int:
    """As held_out() counts it."""
    return zlib.crc32(str(doc_id).encode()) % 4
