"""Benchmark decontamination: which documents hold (nearly) all word shingles of a test item.

Size-partitioned MinHash containment search. Items are dealt into classes by their number of shingles, each class
within a factor of two. An item is sketched by its smallest shingle hashes, as many as its size needs so that a document
holding the threshold's share of the item must hold one of them (with q shingles and threshold t, any
``q - ceil(t*q) + 1`` of them). Every class has its own inverted list and its own limit: the largest hash its items
use. A document is sketched for a class by its shingles up to that limit, at any length, so a short item is found inside
a long document without lowering a Jaccard threshold, large items are searched with short sketches, and no pair over the
threshold is lost. Candidates are then verified by exact containment of the full shingle sets.

The items are sent to the executors in blocks of a bounded number of shingles (``BLOCK``), each searched against all
documents, so the broadcast has a fixed size however many items there are.

Words are runs of non-white-space (``[^\\x20\\x09-\\x0D]+``), lower-cased (A-Z), with marks around a word left out;
an item of fewer than ``size`` words is one shingle of all its words, so it is
not found inside a longer document, only in one of exactly these words (the SQL of op6 has the same rule). Null or empty texts hold nothing and match
nothing. Equal items are reported each under its own item_id; equal documents get equal rows; an empty table of items
matches nothing. Other columns, whatever their names, are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, small_batches

BLOCK = 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordHash(dict):
    """64-bit hash of a word without the marks around it; 0 for marks alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        core = word.strip(STRIP)
        self[word] = value = xxhash.xxh3_64_intdigest(core) or 1 if core else 0
        return value


def shingles(text: str, size: int, words: WordHash) -> np.ndarray:
    """Distinct shingle hashes of a text."""
    h = np.fromiter((words[w] for w in text.encode().translate(LOWER).split()), dtype=np.uint64)
    h = h[h != 0]
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ out >> np.uint64(29)) * np.uint64(_MULT[k % 5]) + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ out >> np.uint64(31))


def need(q: int, percent: int) -> int:
    """Shingles that a document must hold of an item of q."""
    return -(-percent * q // 100)


class SizeClass:
    """Items of similar size, with an inverted list of their sketches."""

    def __init__(self, members: list[tuple[int, np.ndarray]], percent: int):
        slots: dict[int, list[int]] = {}
        for i, s in members:
            for x in s[: len(s) - need(len(s), percent) + 1].tolist():  # sorted: the smallest hashes
                slots.setdefault(x, []).append(i)
        self.keys = np.array(sorted(slots), dtype=np.uint64)
        self.lists = [slots[int(k)] for k in self.keys]

    def candidates(self, doc: np.ndarray) -> Iterator[int]:
        """Places of the items that share a hash with the document's sketch for this class."""
        sketch = doc[: np.searchsorted(doc, self.keys[-1], side="right")]
        at = np.searchsorted(self.keys, sketch)  # the sketch ends at the last key
        for k in at[self.keys[at] == sketch].tolist():
            yield from self.lists[k]


class Index:
    """Items of one block, by size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        members: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (_, s) in enumerate(items):
            members.setdefault(len(s).bit_length(), []).append((i, s))
        self.classes = [SizeClass(members[k], percent) for k in sorted(members)]

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shingles held, shingles of the item) of every item held, in the order of the items."""
        out = []
        for i in sorted({i for c in self.classes for i in c.candidates(doc)}):
            item, s = self.items[i]
            held = int(np.isin(s, doc, assume_unique=True).sum())
            if held >= need(len(s), self.percent):
                out.append((item, held, len(s)))
        return out


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of at most ``BLOCK`` shingles (an item is never split), streamed to the driver."""
    words, block, held = WordHash(), [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").orderBy("item_id")
    for r in rows.toLocalIterator():
        s = shingles(r.text, size, words)
        if block and held + len(s) > BLOCK:
            yield block
            block, held = [], 0
        if len(s):
            block.append((r.item_id, s))
            held += len(s)
    yield block


def matches(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and hits (item_id, held, item_shingles) of every document, items in ascending order."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, size):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, words = Index(sent.value, percent), WordHash()
            for b in batches:
                n, hits = [], []
                for t in b.column("text").to_pylist():
                    s = shingles(t, size, words)
                    n.append(len(s))
                    hits.append([{"item_id": i, "held": h, "item_shingles": q} for i, h, q in index.search(s)])
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("held", pa.int64()), ("item_shingles", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"row": b.column("row"), "doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "hits": pa.array(hits, kind)})

        got = docs_of(docs, F.monotonically_increasing_id().alias("row")).select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, hits array<struct<item_id:long,held:long,item_shingles:long>>")
        out = got if out is None else out.unionByName(got)
        single = out is got
    if single:
        return out.select("doc_id", "n_shingles", "hits")
    return out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).select("doc_id", "n_shingles", "hits")


def clean(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that hold an item, in one pass a block of items; same columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    small_batches(spark)
    for block in item_blocks(items, size):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, words = Index(sent.value, percent), WordHash()
            for b in batches:
                yield b.filter(pa.array([not index.search(shingles(t or "", size, words)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_items, item_ids (comma-joined, ascending) and contaminated."""
    return found.select("doc_id", "n_shingles", F.size("hits").cast("long").alias("n_items"), F.array_join(F.transform("hits", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"), (F.size("hits") > 0).alias("contaminated"))
