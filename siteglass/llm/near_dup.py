"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

Sketch: in round i every shingle is hashed to a bin and offers a value that rounds order first; rounds go on until all
bins are filled, and from round t on each round fills one given bin, so at most 2 t rounds fill every coordinate.
Coordinates agree with a probability equal to the Jaccard similarity, with concentration as of independent ones.

Plan: documents with equal shingle sets form a class, represented by its smallest doc_id (pre-aggregated, so a group
of copies costs one row a task). Representatives meet in buckets of equal bands. Links are verified on full shingle
sets in three passes, each only between components not yet joined: against a bucket's smallest member; against a
member drawn by hash; then all pairs left in a bucket whose components differ. So no link is lost once a pair shares
a band (a pair at 0.8 misses all of 36 bands of 5 with probability 6e-7), and a group of near copies costs few pairs.

Documents without words link with nothing; null text is empty; a row with a null doc_id stays alone (component null,
kept). Rows that repeat a doc_id and text are one document, each getting its result. Where texts differ under one
doc_id, links of either join its class, and sets are compared by the text that sorts first. Texts are taken whole, an
empty table gives an empty result, and columns other than doc_id and text, whatever their names, are ignored. All work
tables lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, docs_of, materialize, work_dir

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
BLOCK_SHINGLES = 1_000_000


@dataclass(frozen=True)
class Params:
    words: int = 4
    percent: int = 80
    bands: int = 36
    rows: int = 5


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingle_set(text: str, size: int, words: WordHash) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    h = np.fromiter((words[w] for w in text.encode().translate(LOWER).split()), dtype=np.uint64)
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ out >> _U(29)) * _U(_MULT[k % 6]) + h[k : k + len(out)]
    return np.unique(mix(out + _U(n)))


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    full = np.full((len(sets), t), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = full.reshape(-1)
    x = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * t):
        h = mix(x + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        spot = (h >> _U(40)).astype(np.int64) % t if i < t else np.int64(i - t)
        np.minimum.at(flat, row * t + spot, (_U(i) << _U(48)) | (h & _U((1 << 40) - 1)) << _U(8))
        open_ = (full == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        go = open_[row]
        if not go.all():
            x, row = x[go], row[go]
    return full


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(s), bands), dtype=np.uint64)
    v = s.reshape(len(s), bands, rows)
    for k in range(rows):
        out = mix((out ^ v[:, :, k]) + _U(_MULT[k % 6]))
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _U(_MULT[0])).view(np.int64)


def describe(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and the band keys."""
    words = WordHash()

    def one(batch: pa.RecordBatch) -> dict:
        n, d, keys = [], [], []
        part: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal part, size
            live = [s for s in part if len(s)]
            got = iter(band_keys(sketch(live, p.bands * p.rows), p.bands, p.rows).tolist()) if live else iter(())
            keys.extend(next(got) if len(s) else [] for s in part)
            part, size = [], 0

        for t in batch.column("text").to_pylist():
            s = shingle_set(t, p.words, words)
            n.append(len(s))
            d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64))
            part.append(s)
            size += len(s)
            if size > 300_000 or len(part) >= 2000:
                flush()
        flush()
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "d1": [int(x[0]) for x in d], "d2": [int(x[1]) for x in d], "bands": keys}

    return arrow_map(docs_of(docs), one, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def packed_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id and compressed text of the documents in ``needed``."""

    def one(batch: pa.RecordBatch) -> dict:
        z = zstandard.ZstdCompressor(level=1)
        return {"doc_id": batch.column("doc_id"), "z": [z.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    return arrow_map(docs_of(docs).join(needed, "doc_id", "left_semi"), one, "doc_id long, z binary").groupBy("doc_id").agg(F.min("z").alias("z"))


def verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
    percent, size = p.percent, p.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, unpack = WordHash(), {}, zstandard.ZstdDecompressor()

        def of(doc: int, z: bytes) -> np.ndarray:
            if doc not in held:
                if len(held) >= 1000:
                    held.clear()
                held[doc] = shingle_set(unpack.decompress(z).decode(), size, words)
            return held[doc]

        for batch in batches:
            a, b, za, zb = (batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))
            ok = []
            for i in range(len(a)):
                s, t = of(a[i], za[i]), of(b[i], zb[i])
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


SALTS = 16  # shares that a key is dealt in where its members meet one row of it


def _by_key(members: DataFrame, one: DataFrame) -> DataFrame:
    """``members`` with the columns of their key's single row in ``one``; a large bucket is spread over ``SALTS`` shares."""
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def joining_links(own: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) that join the components left in each bucket, from rows (key, rep, n, label).

    A bucket of many shingles is dealt in blocks, and each pair of blocks is one bounded group, so any two members
    meet. In a group a bitmap of each set bounds the symmetric difference from below, which rules pairs out without
    loss; the others are compared in full, and only links between components not yet joined are returned.
    """
    count = own.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = _by_key(own, count).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "rep", "label", "block", other).select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "rep", "label", (F.col("block") > F.col("other")).alias("upper"), (F.col("block") == F.col("other")).alias("same"))
    rows = dealt.join(texts.select(F.col("doc_id").alias("rep"), "z"), "rep")
    parts = 2 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    percent, size = p.percent, p.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = WordHash(), zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        group, members = None, []

        def of(rep: int, z: bytes) -> np.ndarray:
            if rep not in held:
                if len(held) > 2000:
                    held.clear()
                held[rep] = shingle_set(unpack.decompress(z).decode(), size, words)
            return held[rep]

        def done() -> pa.RecordBatch:
            found = join_group([(r, lab, up, same, of(r, z)) for r, lab, up, same, z in members], percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("group", "rep", "label", "upper", "same", "z")), strict=True):
                if g != group and members:
                    yield done()
                    members = []
                group = g
                members.append(row)
        if members:
            yield done()

    ordered = rows.select("group", "rep", "label", "upper", "same", "z").repartition(parts, "group").sortWithinPartitions("group", "rep")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def join_group(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of (rep, label, upper, same, set); across blocks unless they are the same."""
    rep = [m[0] for m in members]
    root = np.unique([m[1] for m in members], return_inverse=True)[1]
    upper, whole = np.array([m[2] for m in members]), members[0][3]
    sets = [m[4] for m in members]
    n = np.array([len(s) for s in sets])
    bits = 1 << min(16, max(6, int(4 * n.max() - 1).bit_length()))
    maps = np.zeros((len(members), bits // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        flags = np.zeros(bits, dtype=bool)
        flags[(s >> _U(8) & _U(bits - 1)).astype(np.int64)] = True
        maps[i] = np.packbits(flags).view(np.uint64)
    out = []
    for i in range(len(members)):
        mine = root != root[i]
        if whole:
            mine[:i] = False
        elif upper[i]:
            continue
        else:
            mine &= upper
        at = np.flatnonzero(mine)
        at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
        for lo in range(0, len(at), 2048):
            part = at[lo : lo + 2048]
            apart = np.bitwise_count(maps[part] ^ maps[i]).sum(axis=1, dtype=np.int64)
            for j in part[apart * (100 + percent) <= (100 - percent) * (n[part] + n[i])].tolist():
                if root[j] == root[i]:
                    continue
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (n[i] + n[j] - common):
                    root[root == root[j]] = root[i]
                    out.append((rep[i], rep[j]))
    return out


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node and root (smallest node reachable) of every node of ``edges`` (a, b).

    Each round hooks a node to its smallest neighbour, follows the hooks by doubling, and contracts the edges, until
    none is left; so long chains take few rounds. Rounds are cut by written tables.
    """
    rest, root = edges, None
    while True:
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = _flat(materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), folder), folder)
        if root is None:
            root = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            root = materialize(root.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), folder)
        ha, hb = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = materialize(rest.join(ha, "a").join(hb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), folder)
        if rest.isEmpty():
            return root


def _flat(root: DataFrame, folder: str) -> DataFrame:
    """Follow roots of roots until nothing moves."""
    while True:
        up = root.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
        if up.isEmpty() or root.join(up, "root", "left_semi").isEmpty():
            return root
        root = materialize(root.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), folder)


def near_duplicates(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    p = p or Params()
    folder = work_dir(docs.sparkSession)
    all_ = materialize(describe(docs, p), folder)
    live = all_.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(live.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m")).select("d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")), folder)
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", F.col("first"))
    rows = materialize(rows.join(shared, "key").select("key", "first", "rep", "n"), folder)  # members of buckets of two or more
    texts = materialize(packed_texts(docs, rows.select(F.col("rep").alias("doc_id")).distinct()), folder)

    def near(x: str, y: str):
        return f"100 * least({x}, {y}) >= {p.percent} * greatest({x}, {y})"

    size = rows.select("rep", "n").distinct()
    pairs = rows.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"), "n").distinct()
    pairs = pairs.join(size.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").where(near("n", "na")).select("a", "b")
    tried = materialize(pairs, folder)
    links = materialize(verify(tried, texts, p), folder)
    root = components(links, folder)

    def labelled() -> DataFrame:
        """Bucket members with their components, of buckets that hold several."""
        own = rows.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("label"))
        mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return materialize(_by_key(own, mixed), folder)

    own = labelled()
    if not own.isEmpty():
        pivot = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))).alias("m")).select("key", "m.a", "m.na", "m.la")
        pairs = _by_key(own, pivot).where("label <> la and rep <> a").where(near("n", "na"))
        pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), folder)
        links = links.unionByName(materialize(verify(pairs, texts, p), folder))
        root = components(links, folder)
        own = labelled()
        if not own.isEmpty():
            links = links.unionByName(materialize(joining_links(own, texts, p), folder))
            root = components(links, folder)
    classes = reps.join(_flat(root, folder).select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("component"))
    out = all_.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
