"""Removal of repeated byte strings by longest-previous-factor arrays, over a whole corpus.

Positions are all bytes of all texts, ordered by doc_id and place. A byte goes when a string of ``length`` bytes
over it also starts earlier, so the first copy stays and every later one is cut.

One suffix array of a corpus would not fit, so it is dealt out: windows of ``length`` bytes that are equal hold the same
minimizer (the smallest hash of their ``gram``-byte strings) at the same place, and runs of windows with one minimizer
are dealt by its hash, so equal windows meet. Runs that are equal as a whole are settled by their 64-bit hash within
one minimizer, in each batch already (and a frequent one in each task, so a passage in a third of all documents costs
about one row a task). Runs that share a minimizer but differ bring their bytes. These are put in suffix order with the
lengths of their common prefixes; previous and next smaller positions in that order give every window its longest
previous factor, up to ``length``, and a window whose factor reaches ``length`` goes.

A minimizer that holds more than a ``SHARE``-th of an average partition would make its task long. Such minimizers are
looked for in every ``SAMPLE``-th document (this steers the dealing, never the result), and their runs are cut into
shorter ones by minimizers of longer strings; where these are frequent too, into single windows, whose key is the whole
window, so that all that meet are equal and are settled without their bytes.

Null text is empty; texts under ``length`` bytes keep every byte. Rows with a null doc_id are left out of the search
and keep their bytes. Rows that repeat a doc_id and text are one document, each getting its result; other columns are
ignored. Texts of one doc_id that differ are compared by place, as if they were one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, materialize, work_dir

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POS_BITS, _COUNT_BITS = 31, 16
SLICE = 4_000_000
HOT_RUNS = 50_000
SAMPLE = 64  # every so many documents are looked through for frequent minimizers
LEAST_HOT, SHARE = 4, 4  # sampled runs, and part of an average partition, from which a minimizer's runs are cut


@dataclass(frozen=True)
class Params:
    length: int = 100
    gram: int = 32

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length < 1 << _COUNT_BITS:
            raise ValueError(f"needs 0 < gram <= length < {1 << _COUNT_BITS}")

    @property
    def grams(self) -> tuple[int, ...]:
        """Lengths of the strings whose minimizers deal runs, and those of frequent ones again."""
        return self.gram, (self.gram + self.length) // 2, self.length


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    x = (x ^ x >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(32)


# ---------------------------------------------------------------- suffix order


def previous_factors(order: list[int], common: list[int]) -> np.ndarray:
    """Longest previous factor of every position from the positions in suffix order.

    ``common[i]`` is the length of the common prefix of the i-th position in order and the one before it. The earlier
    position with the longest common prefix is the previous or the next smaller one in the order; a stack of rising
    positions meets both, and carries the common prefix down to each. Linear in the number of positions.
    """
    out, stack = [0] * len(order), []  # of (position, common prefix with the position below it)
    for at, shared in zip(order, common, strict=True):
        while stack and stack[-1][0] > at:  # ``at`` is the next smaller one of the top
            top, below = stack.pop()
            out[top] = below if below > shared else shared
            if below < shared:
                shared = below
        stack.append((at, shared))
    for at, below in stack:
        out[at] = below
    return np.array(out, dtype=np.int64)


def longest_previous_factor(text: bytes) -> np.ndarray:
    """For every position of one text, the length of the longest string from there that also starts earlier."""
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def shared(a: int, b: int) -> int:
        most = len(text) - max(a, b)
        return next((k for k in range(most) if text[a + k] != text[b + k]), most)

    return previous_factors(order, [0, *(shared(a, b) for a, b in zip(order, order[1:], strict=False))][: len(order)])


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the ascending places ``at`` in the order of the ``depth`` bytes there, equal ones by place, and the
    common prefix of each with the one before it."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, shape=(len(padded) - 7, 8), strides=(1, 1))
    short = np.uint64(8 * max(0, 8 - depth))

    def key(places: np.ndarray) -> np.ndarray:
        """The eight bytes at each place (or ``depth``, if it is less) as numbers in the order of strings."""
        return np.ascontiguousarray(eights[places]).view(">u8")[:, 0].astype(np.uint64) >> short

    def agreed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many leading bytes of differing keys agree."""
        apart, out = (x ^ y) << short, np.zeros(len(x), dtype=np.int64)
        for k in range(1, 8):
            out += apart >> np.uint64(64 - 8 * k) == 0
        return out

    steps = [*range(0, max(1, depth - 7), 8)]
    if depth > 8 and depth % 8:
        steps.append(depth - 8)  # overlaps what is known to be equal
    first = key(at)
    order, start, common = np.argsort(first, kind="stable"), np.zeros(len(at), dtype=bool), np.full(len(at), depth, dtype=np.int64)
    first = first[order]
    new = np.flatnonzero(first[1:] != first[:-1]) + 1
    start[0], start[new] = True, True
    common[0], common[new] = 0, agreed(first[new], first[new - 1])
    del first
    for step in steps[1:]:  # refine the stretches that are still equal
        spots = np.flatnonzero(~start | np.append(~start[1:], False))
        if not len(spots):
            break
        group = np.cumsum(start)[spots]
        sub = order[spots]
        more = key(at[sub] + step)
        again = np.lexsort((more, group))
        order[spots] = sub[again]
        more, group = more[again], group[again]
        new = np.flatnonzero((more[1:] != more[:-1]) & (group[1:] == group[:-1])) + 1
        start[spots[new]] = True
        common[spots[new]] = step + agreed(more[new], more[new - 1])
    return order, common


def repeated_windows(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` bytes at the ascending places ``at`` equal one at an earlier place: those whose
    longest previous factor (among the windows, to the depth of ``length``) reaches ``length``."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    order, common = suffix_order(text, at, length)
    return previous_factors(order.tolist(), common.tolist()) >= length


# ---------------------------------------------------------------- runs of windows


def _slides(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done, span = h, 1
    while span * 2 <= width:
        done = np.minimum(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def _lowest(text: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of ``length`` bytes, the smallest hash of its strings of ``gram`` bytes, cut to leave room for
    its place; and all the hashes."""
    n = len(text)
    t = _TABLE[text]
    g, span, base = t, 1, _BASE
    parts = []  # binary expansion of the gram's length
    left = gram
    while True:
        if left & 1:
            parts.append((span, g, base))
        left >>= 1
        if not left:
            break
        g, span, base = g[:-span] * base + g[span:], span * 2, _U(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)
    total, at = None, 0
    for span, arr, base in parts:
        total, at = (arr, span) if total is None else (total[: n - at - span + 1] * base + arr[at : n - span + 1], at + span)
    full = mix(total)
    return _slides((full & ~_U((1 << _POS_BITS) - 1)) | np.arange(len(full), dtype=np.uint64), length - gram + 1), full


def window_runs(raw: bytes, ends: np.ndarray, p: Params, frequent: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of windows of concatenated texts: start, windows, key and hash of each run.

    The key is the minimizer's hash; runs whose key is ``frequent`` are cut at longer minimizers, which join the key.
    """
    text, place = np.frombuffer(raw, dtype=np.uint8), _U((1 << _POS_BITS) - 1)
    n, none = len(text), (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    if n < p.length:
        return none
    low, full = _lowest(text, p.gram, p.length)
    m = len(low)
    ok = np.ones(m, dtype=bool)
    for e in ends[:-1]:
        ok[max(0, e - p.length + 1) : e] = False
    new = np.ones(m, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    if not len(start):
        return none
    stop = np.searchsorted(np.flatnonzero(new | ~ok), start, side="right")
    edges = np.append(np.flatnonzero(new | ~ok), m)
    count, key = edges[stop] - start, full[(low[start] & place).astype(np.int64)]
    done = []
    for gram, hot in zip(p.grams[1:], frequent, strict=False):
        again = np.isin(key, hot)
        done.append((start[~again], count[~again], key[~again]))
        start, count, key = start[again], count[again], key[again]
        if not len(start):
            break
        low, full = _lowest(text, gram, p.length)
        first = np.cumsum(count) - count
        window = np.repeat(start - first, count) + np.arange(int(count.sum()))
        new = np.append(True, low[window[1:]] != low[window[:-1]])
        new[first] = True
        at = np.flatnonzero(new)
        key = mix(np.repeat(key, count)[at] ^ full[(low[window[at]] & place).astype(np.int64)])
        start, count = window[at], np.diff(np.append(at, len(window)))
    start, count, key = (np.concatenate(x) for x in zip(*done, (start, count, key), strict=True))
    run = xxhash.xxh3_64_intdigest
    whole = np.fromiter((run(raw[i:j]) for i, j in zip(start.tolist(), (start + count + p.length - 1).tolist(), strict=True)), dtype=np.uint64, count=len(start))
    return start, count, key, whole


RUN = "route long, seen long, doc_id long, place long"
DONE, ASK = 0, 1  # what is said of a run: settled, or bytes wanted


def _place(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start << np.int64(_COUNT_BITS) | count


def runs_of(docs: DataFrame, p: Params, frequent: list[np.ndarray]) -> DataFrame:
    """Rows (route, seen, doc_id, place): seen is the run's hash, or 0 for a run known to repeat an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[int, tuple[int, tuple[int, int]]] = {}  # frequent runs of the task: minimizer, earliest place sent
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column("text").to_pylist()
            order = np.argsort(ids, kind="stable")
            lo = 0
            got = []
            while lo < len(order):
                part, size = [], 0
                while lo < len(order) and (not part or size < SLICE):
                    raw = texts[order[lo]].encode()
                    if len(raw) >= p.length:
                        part.append((ids[order[lo]], raw))
                        size += len(raw)
                    lo += 1
                if not part:
                    continue
                ends = np.cumsum([len(r) for _, r in part])
                start, count, mini, whole = window_runs(b"".join(r for _, r in part), ends, p, frequent)
                doc = np.searchsorted(ends, start, side="right")
                first = np.concatenate(([0], ends[:-1]))
                got.append((mini, whole, np.array([d for d, _ in part], dtype=np.int64)[doc], _place(start - first[doc], count)))
            if not got:
                continue
            mini, whole, doc, place = (np.concatenate(c) for c in zip(*got, strict=True))
            # equal runs of a batch: all but the first are settled here
            at = np.lexsort((place, doc, mini, whole))
            mini, whole, doc, place = (x[at] for x in (mini, whole, doc, place))
            again = np.append(False, (whole[1:] == whole[:-1]) & (mini[1:] == mini[:-1]))
            twice = np.append(False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])) & again  # of a repeated row
            mini, whole, doc, place, again = (x[~twice] for x in (mini, whole, doc, place, again))
            lead = np.flatnonzero(~again & np.append(again[1:], False))  # runs with repeats in this batch
            kept = np.flatnonzero(~again)
            for i in kept[np.isin(whole[kept], np.fromiter(hot, dtype=np.uint64, count=len(hot)))].tolist() if hot else ():
                m, at = hot[int(whole[i])]
                if m == mini[i] and at != (own := (int(doc[i]), int(place[i]))):
                    again[i] = own > at
                    hot[int(whole[i])] = m, min(at, own)
            if len(hot) > HOT_RUNS:
                hot.clear()
            for i in lead.tolist():
                hot.setdefault(int(whole[i]), (int(mini[i]), (int(doc[i]), int(place[i]))))
            whole[whole == 0] = 1
            seen = np.where(again, _U(0), whole)
            route = np.where(again, mix(doc.astype(np.uint64) + _U(7)), mini)
            keep = ~again
            yield _runs(route[keep], seen[keep], doc[keep], place[keep])
            yield _runs(*_joined(route[again], doc[again], place[again]))

    return docs.mapInArrow(run, RUN)


def _joined(route: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Settled runs that touch become one (of at most 2**16 windows)."""
    if not len(doc):
        return route, np.zeros(0, dtype=np.uint64), doc, place
    order = np.lexsort((place, doc))
    route, doc, place = route[order], doc[order], place[order]
    start, count = place >> _COUNT_BITS, place & (1 << _COUNT_BITS) - 1
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
    lead = np.flatnonzero(new)
    since = np.arange(len(doc)) - np.repeat(lead, np.diff(np.append(lead, len(doc))))
    new |= since % 200 == 0  # a run has at most length - gram + 1 windows
    lead = np.flatnonzero(new)
    return route[lead], np.zeros(len(lead), dtype=np.uint64), doc[lead], _place(start[lead], np.add.reduceat(count, lead))


def _runs(route: np.ndarray, seen: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"route": pa.array(route.view(np.int64)), "seen": pa.array(seen.view(np.int64)), "doc_id": pa.array(doc), "place": pa.array(place)})


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    kept = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(c) if kept else np.zeros(0, dtype=np.int64) for c in (zip(*kept, strict=True) if kept else [()] * len(names))]


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one route together: later equal runs are settled, differing ones ask for their bytes."""
    route, seen, doc, place = _columns(batches, ("route", "seen", "doc_id", "place"))
    if not len(route):
        return
    done = seen == 0
    yield _runs(route[done].view(np.uint64), np.zeros(int(done.sum()), dtype=np.uint64), doc[done], place[done])
    route, seen, doc, place = (x[~done] for x in (route, seen, doc, place))
    order = np.lexsort((place, doc, seen, route))
    route, seen, doc, place = (x[order] for x in (route, seen, doc, place))
    if not len(route):
        return
    twice = np.append(False, (route[1:] == route[:-1]) & (seen[1:] == seen[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]))
    route, seen, doc, place = (x[~twice] for x in (route, seen, doc, place))
    group = np.append(True, route[1:] != route[:-1])
    first = group | np.append(True, seen[1:] != seen[:-1])
    kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(group))
    ask = first & (np.repeat(kinds, np.diff(np.append(np.flatnonzero(group), len(route)))) > 1)
    said = np.where(ask, _U(ASK), _U(DONE))
    out = ask | ~first
    for lo in range(0, len(out), 100_000):
        s = slice(lo, lo + 100_000)
        k = out[s]
        yield _runs(route[s][k].view(np.uint64), said[s][k], doc[s][k], place[s][k])


def settle_windows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Bytes of runs, those of one minimizer next to each other: the stretches of windows that equal an earlier one."""
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("route", "doc_id", "place", "bytes")), strict=True):
            if size >= SLICE and row[0] != rows[-1][0]:  # whole groups
                yield _stretches(rows, p)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield _stretches(rows, p)


def _stretches(rows: list[tuple], p: Params) -> pa.RecordBatch:
    """Settled stretches of the windows of (route, doc_id, place, bytes)."""
    rows.sort(key=lambda r: r[1:3])  # by position in the corpus
    part = [r for i, r in enumerate(rows) if not i or r[1:3] != rows[i - 1][1:3]]  # repeated rows are one
    counts = np.array([r[2] & (1 << _COUNT_BITS) - 1 for r in part], dtype=np.int64)
    firsts = np.cumsum([0] + [len(r[3]) for r in part[:-1]])
    which = np.repeat(np.arange(len(part)), counts)
    inside = np.arange(int(counts.sum())) - (np.cumsum(counts) - counts)[which]
    hit = repeated_windows(np.frombuffer(b"".join(r[3] for r in part), dtype=np.uint8), firsts[which] + inside, p.length)
    at = np.flatnonzero(hit)
    s = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])))[: len(at)]
    n = np.diff(np.append(s, len(at)))
    w = which[at[s]]
    doc, start = np.array([r[1] for r in part], dtype=np.int64)[w], np.array([r[2] >> _COUNT_BITS for r in part], dtype=np.int64)[w] + inside[at[s]]
    return _runs(np.zeros(len(s), dtype=np.uint64), np.zeros(len(s), dtype=np.uint64), doc, _place(start, n))


def frequent_keys(docs: DataFrame, p: Params, parts: int, folder: str) -> list[np.ndarray]:
    """By level, the keys that hold over a ``SHARE``-th of an average one of ``parts`` partitions, by a sample of
    documents; at most ``SHARE * parts`` a level, since each holds that much of the total."""
    sample = materialize(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), folder)
    found: list[np.ndarray] = []
    while len(found) < len(p.grams) - 1:
        rows = runs_of(sample, p, found).where(F.col("seen") != 0).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(rows.where(F.col("n") >= 2), folder)
        total = counts.agg(F.sum("n")).first()[0] or 0
        hot = counts.where(F.col("n") >= max(LEAST_HOT, total / (SHARE * parts))).select("route").collect()
        if not hot:
            break
        found.append(np.sort(np.array([r.route for r in hot], dtype=np.int64).view(np.uint64)))
    return found


def _per_doc(asks: DataFrame) -> DataFrame:
    return asks.groupBy("doc_id").agg(F.collect_list(F.struct("route", "place")).alias("asks"))


def covered(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id and places: the stretches of windows (start << 16 | windows) of each document that repeat."""
    p = p or Params()
    spark = docs.sparkSession
    folder = work_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs_of(docs).where("doc_id is not null")
    state = materialize(runs_of(base, p, frequent_keys(base, p, 2 * parts, folder)).repartition(2 * parts, "route").mapInArrow(settle, RUN), folder)
    length = p.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, asks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "asks")), strict=True):
                raw = text.encode()
                out += [(a["route"], doc, a["place"], raw[a["place"] >> _COUNT_BITS : (a["place"] >> _COUNT_BITS) + (a["place"] & (1 << _COUNT_BITS) - 1) + length - 1]) for a in asks]
            for lo in range(0, len(out), 50_000):
                cols = list(zip(*out[lo : lo + 50_000], strict=True))
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("route", "doc_id", "place", "bytes"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    asks, done = (state.where(F.col("seen") == x) for x in (ASK, DONE))
    segments = base.join(_per_doc(asks), "doc_id").mapInArrow(cut, "route long, doc_id long, place long, bytes binary")
    ordered = segments.repartition(2 * parts, "route").sortWithinPartitions("route")
    more = materialize(ordered.mapInArrow(lambda it: settle_windows(it, p), RUN), folder)
    return done.unionByName(more).groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes and the removed spans of every document."""
    p = p or Params()
    length = p.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            kept, size, spans = [], [], []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                raw = text.encode()
                found, left, end = [], [], 0
                for x in sorted(places or ()):
                    s, e = x >> _COUNT_BITS, (x >> _COUNT_BITS) + (x & (1 << _COUNT_BITS) - 1) + length - 1
                    if found and s <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], e)
                    else:
                        found.append([s, e])
                for s, e in found:
                    left.append(raw[end:s])
                    end = e
                left.append(raw[end:])
                kept.append(b"".join(left))
                size.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in found])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "spans": pa.array(spans, kind)})

    return docs_of(docs).join(covered(docs, p), "doc_id", "left").select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, spans array<struct<start:long,end:long>>")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
