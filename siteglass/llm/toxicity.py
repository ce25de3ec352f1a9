"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term leaves most weights at zero, so the model ships as two
short arrays. Features of a text are the distinct hashes of its words, their stems, word pairs and pairs that skip one
word, after lower-casing and stripping of marks around a word. Training reads a bounded sample of the labelled documents,
in the order of the hash of their doc_id: at most ``Params.max_rows`` of them, and as many as have ``Params.max_slots``
features together. Executors make the features; the driver gets slot numbers, never texts. Scoring covers every row.

Null or empty text has no features and gets the bias; texts of any length count whole. Rows with a null label or null
doc_id never train; repeated label rows of a document keep the highest, and documents that share a doc_id train once,
as the one with the fewest features. Equal texts get equal scores. Without documents the result is empty, without
labels every score is 0.5. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, docs_of, materialize

STEM = 5
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    max_rows: int = 12_000
    max_slots: int = 30_000_000


class Words(dict):
    """Number of each word seen, with the hashes of the normalized word and of its stem by that number.

    A hash is 0 for marks alone, and a stem's also for words no longer than it. Emptied when it grows past a bound.
    """

    def __init__(self):
        super().__init__()
        self.word, self.stem = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.word):
            self.word, self.stem = np.concatenate((self.word, np.zeros_like(self.word))), np.concatenate((self.stem, np.zeros_like(self.stem)))
        clean = _STRIP.sub("", word.lower())
        self.word[n] = _hash(clean) if clean else 0
        self.stem[n] = _hash(clean[:STEM] + "~") if len(clean) > STEM else 0
        self[word] = n
        return n


def _hash(text: str) -> int:
    return (zlib.crc32(text.encode()) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF


def features(texts: list[str], bits: int, words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each text, ordered by row; only of slots that are ``wanted``."""
    if len(words) > 400_000:
        words.clear()
    parts = [t.split() for t in texts]
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    number = np.fromiter((words[w] for p in parts for w in p), dtype=np.int64, count=int(lens.sum()))
    h, s = words.word[number], words.stem[number]
    row = np.repeat(np.arange(len(parts), dtype=np.uint64), lens)
    s, stem_row = s[s != 0], row[s != 0]
    h, row = h[h != 0], row[h != 0]
    shift, out = np.uint64(64 - bits), []
    for gap, mult in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (-1, 0x2545F4914F6CDD1D)):
        a, b, r = (h, h, row) if gap == 0 else (s, s, stem_row) if gap < 0 else (h[:-gap], h[gap:], row[:-gap])
        same = slice(None) if gap <= 0 else row[:-gap] == row[gap:]
        mixed = (a[same] * np.uint64(mult)) ^ (b[same] * np.uint64(mult + 2 * abs(gap)) >> np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slot, r = mixed >> shift, r[same]
        if wanted is not None:
            hit = wanted[slot.astype(np.int64)]
            slot, r = slot[hit], r[hit]
        out.append((r << np.uint64(bits)) | slot)
    keys = np.unique(np.concatenate(out))
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def fit(data: list[tuple[np.ndarray, int]], p: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero slots, their weights and the bias, from the slots and the label of each example."""
    size = 1 << p.bits
    z, n, n0, z0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(len(data)):
            s, y = data[i]
            zs, ns = z[s], n[s]
            w = np.where(np.abs(zs) <= p.l1, 0.0, (np.sign(zs) * p.l1 - zs) / ((p.beta + np.sqrt(ns)) / p.alpha + p.l2))
            w0 = -z0 / ((p.beta + np.sqrt(n0)) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / p.alpha
            z[s] = zs + g - sigma * w
            n[s] = ns + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / p.alpha * w0
            n0 += g * g
    at = np.flatnonzero(np.abs(z) > p.l1)
    return at, (np.sign(z[at]) * p.l1 - z[at]) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2), float(-z0 / ((p.beta + np.sqrt(n0)) / p.alpha))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> list[tuple[np.ndarray, int]]:
    """The bounded sample of (slots, label) outside the held-out fifth, by doc_id."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    words, bits = Words(), p.bits

    def one(batch: pa.RecordBatch) -> dict:
        texts, slots = batch.column("text").to_pylist(), []
        for lo in range(0, len(texts), 64):
            part = texts[lo : lo + 64]
            row, slot = features(part, bits, words)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            slots += [slot[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(len(part))]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "slots": slots}

    made = arrow_map(docs_of(docs).join(F.broadcast(lab), "doc_id"), one, "doc_id long, toxic int, slots binary")  # at most max_rows labels
    once = materialize(made.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "slots"), F.struct(F.length("slots"), "slots")).alias("x")).select("doc_id", "x.*"))
    upto = F.sum(F.length("slots")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # one order of at most max_rows sizes
    chosen = once.select("doc_id", upto.alias("upto")).where(F.col("upto") <= 4 * p.max_slots).select("doc_id")
    got = once.join(F.broadcast(chosen), "doc_id").collect()
    return [(np.frombuffer(bytes(r.slots), dtype="<i4"), r.toxic) for r in sorted(got, key=lambda r: r.doc_id)]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: Params) -> DataFrame:
    """doc_id, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []
    used: list[np.ndarray] = []
    words = Words()
    bits = p.bits

    def one(batch: pa.RecordBatch) -> dict:
        at, weights, bias = sent.value
        if not dense:
            dense.append(np.zeros(1 << bits))
            dense[0][at] = weights
            used.append(dense[0] != 0)
        texts, out = batch.column("text").to_pylist(), []
        for lo in range(0, len(texts), 512):
            part = texts[lo : lo + 512]
            row, slot = features(part, bits, words, used[0])
            out.append(np.bincount(row, dense[0][slot], minlength=len(part)) + bias)
        s = 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -35, 35)))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return arrow_map(docs_of(docs), one, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """Fit on the labels outside the held-out fifth, then score every document."""
    p = p or Params()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, fit(training_rows(docs, labels, p), p), p).select("doc_id", held.alias("held_out"), "score", "predicted")
