"""Token ids of whole texts by the ``tokenizers`` library, and their file format.

Encoding: the byte-level vocabulary never joins across certain places, so texts are cut there and every distinct
piece is encoded by the library once per worker (bounded memory); ids equal those of encoding the text at once. An added
token (``<|endoftext|>``) that a text holds gets its own id, as in the library's plain call; no cut falls into one.

File format: ids are replaced by their rank in the corpus-wide frequency order (rank 0 is the most frequent, ties by
id) and written in byte-aligned variable-length code: two control bits per value, four to a control byte kept apart
from the data, which has one to four little-endian bytes a value. Decoding looks the four lengths of a control byte
up in a table and gathers with numpy. A file is a Parquet container of blocks; the rank table is stored beside it.

Null text is empty and yields only the end id. Rows with a null doc_id sort first. Rows with one doc_id follow each
other in the order of their ids, so equal rows are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, docs_of, materialize, work_dir

END_ID = 0
_U = np.uint64
SHORT, MIDDLE = 16, 512  # bytes of a piece that is its own key in the table, and of one kept in a dictionary
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MARKS = ",.;:!?"
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)  # of letters in two bytes: Latin, Greek, Cyrillic
_LEAD[0xC3:0xCB] = _LEAD[0xCE:0xD2] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.isin(np.arange(256), [ord(m) for m in _MARKS])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class Encoder:
    """Ids of texts, by pieces that are encoded once.

    Pieces begin at a single space or line feed between visible characters, and at a mark between a letter and such a
    place; the vocabulary never joins across these. Pieces are told apart by their bytes, never by a hash of them: up
    to ``SHORT`` bytes are two numbers that key an open table, looked up for all pieces of many texts at once; up to
    ``MIDDLE`` bytes key a dictionary; longer ones are encoded each time. Both tables start anew when
    they hold ``room`` pieces, or a 32nd of it in the dictionary.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab, added = self.tok.get_vocab(), self.tok.get_added_tokens_decoder()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for piece, i in vocab.items():  # a byte-level vocabulary spells each byte as one character, but added tokens as they are
            self.width[i] = len(piece.encode()) if i in added else len(piece)
        self.room, self.bits = room, max(10, (2 * room - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.low, self.high = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.uint64)
        self.size, self.value = np.zeros(1 << self.bits, dtype=np.int8), np.zeros(1 << self.bits, dtype=np.int32)
        self.middle: dict[bytes, int] = {}
        self.at, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.pool, self.used, self.pieces = np.zeros(4096, dtype="<u4"), 0, 0
        marks = [self._plain(m) for m in _MARKS]
        first = self._hold(np.concatenate(marks), np.array([len(m) for m in marks]))
        self._add(np.frombuffer(_MARKS.encode(), dtype=np.uint8).astype(np.uint64), np.zeros(len(marks), dtype=np.uint64), np.ones(len(marks), dtype=np.int8), first)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (_mix(low ^ _mix(high + size.astype(np.uint64))) & _U((1 << self.bits) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of short pieces, or -1."""
        out, left, slot = np.full(len(low), -1, dtype=np.int64), np.arange(len(low)), self._slots(low, high, size)
        while len(left):
            held = self.size[slot]
            hit = (held == size[left]) & (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            out[left[hit]] = self.value[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on] + 1 & (1 << self.bits) - 1
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Enter short pieces that are not in the table yet, each once."""
        left, slot = np.arange(len(low)), self._slots(low, high, size)
        while len(left):
            free = np.flatnonzero(self.size[slot] == 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            s, w = slot[first], left[first]
            self.low[s], self.high[s], self.size[s], self.value[s] = low[w], high[w], size[w], number[w]
            on = np.ones(len(left), dtype=bool)
            on[first] = False
            left, slot = left[on], slot[on] + 1 & (1 << self.bits) - 1

    def _hold(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keep the ids of new pieces; returns the pieces' numbers."""
        n = len(count)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.pieces + n > len(self.at):
            self.at, self.count = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.count, np.zeros_like(self.count)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.pieces : self.pieces + n] = self.used + np.cumsum(count) - count
        self.count[self.pieces : self.pieces + n] = count
        self.used, self.pieces = self.used + len(ids), self.pieces + n
        return np.arange(self.pieces - n, self.pieces)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces together; returns their numbers."""
        ids = self._plain(b"".join(pieces).decode())
        stop = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in pieces])) + 1
        return self._hold(ids, np.diff(stop, prepend=0))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        raws = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        buf = b"".join(raws)
        n = len(buf)
        if not n:
            return [np.zeros(0, dtype="<u4") for _ in texts]
        x = np.frombuffer(buf, dtype=np.uint8)
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        shown = _VISIBLE[x]
        last = shown.copy()  # a visible character ends here
        last[1:] |= (x[1:] & 0xC0 == 0x80) & _LEAD[x[:-1]]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1 : n - 1] = ((x[1:-1] == 32) | (x[1:-1] == 10)) & last[:-2] & (shown[2:] | _LEAD[x[2:]])
        cut[ends[sizes > 0] - 1] = False
        cut[begins] = True
        cut[n] = True
        marks = np.zeros(n, dtype=bool)
        marks[1:] = _MARK[x[1:]] & _LETTER[x[:-1]] & cut[2:]
        marks[begins] = False
        cut[:n] |= marks
        start = np.flatnonzero(cut[:n])
        size = np.diff(np.append(start, n))
        alone = np.zeros(n, dtype=bool)  # first pieces, and pieces that end in no visible character
        alone[begins] = True
        alone = alone[start] | ~last[start + size - 1]
        alone |= size > MIDDLE
        if self.pieces + len(start) > self.room or len(self.middle) > self.room // 32:
            self._clear()
        if self.pieces + len(start) > 1 << self.bits - 1:
            self.bits = (2 * len(start)).bit_length() + 1
            self._clear()
        which = np.full(len(start), -1, dtype=np.int64)
        own = np.flatnonzero(~alone & (size <= SHORT))
        eights = np.lib.stride_tricks.as_strided(np.frombuffer(buf + bytes(SHORT), dtype=np.uint8), shape=(n + 8, 8), strides=(1, 1))
        low, high = (np.ascontiguousarray(eights[start[own] + k]).view("<u8")[:, 0] & _KEEP[np.clip(size[own] - k, 0, 8)] for k in (0, 8))
        short = size[own].astype(np.int8)
        got = self._find(low, high, short)
        while len(new := np.flatnonzero(got < 0)):
            once = new[np.unique(_mix(low[new] ^ _mix(high[new] + short[new].astype(np.uint64))), return_index=True)[1]]
            for lo in range(0, len(once), 5000):
                part = once[lo : lo + 5000]
                at = own[part]
                self._add(low[part], high[part], short[part], self._learn([buf[i:j] for i, j in zip(start[at].tolist(), (start[at] + size[at]).tolist(), strict=True)]))
            got[new] = self._find(low[new], high[new], short[new])
        which[own] = got
        mid = np.flatnonzero(~alone & (size > SHORT))
        if len(mid):
            raw = [buf[i:j] for i, j in zip(start[mid].tolist(), (start[mid] + size[mid]).tolist(), strict=True)]
            once = [x for x in dict.fromkeys(raw) if x not in self.middle]
            for lo in range(0, len(once), 500):
                part = once[lo : lo + 500]
                self.middle.update(zip(part, self._learn(part).tolist(), strict=True))
            which[mid] = [self.middle[x] for x in raw]
        single = np.flatnonzero(alone)
        got = [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast([buf[i:j].decode() for i, j in zip(start[single].tolist(), (start[single] + size[single]).tolist(), strict=True)], add_special_tokens=False)]
        at, count = self.at[which], self.count[which]
        lens = np.array([len(g) for g in got], dtype=np.int64)
        at[single], count[single] = self.used + np.cumsum(lens) - lens, lens
        pool = np.concatenate((self.pool[: self.used], *got))
        total = np.cumsum(count)
        ids = pool[np.repeat(at - (total - count), count) + np.arange(int(total[-1]))]
        done = np.concatenate(([0], total))[np.searchsorted(start, np.concatenate(([0], ends)))]
        return [ids[i:j] for i, j in zip(done[:-1].tolist(), done[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_in_parts(enc: Encoder, texts: list[str], chars: int = 500_000) -> Iterator[bytes]:
    """Little-endian ids of each text with the end id, encoded in slices of bounded size."""
    end, part, size = np.array([END_ID], dtype="<u4").tobytes(), [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield from (x.tobytes() + end for x in enc.encode(part))
            part, size = [], 0
    if part:
        yield from (x.tobytes() + end for x in enc.encode(part))


# ---------------------------------------------------------------- byte-aligned code

_LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)
_BYTES_OF = _LENGTHS.sum(axis=1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of :func:`pack`, by table lookup on the control bytes."""
    if not count:
        return np.zeros(0, dtype="<u4")
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype("<u4")
    for k in range(1, 4):
        more = size > k
        if more.any():
            out[more] |= raw[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


# ---------------------------------------------------------------- whole tables

BLOCK = 1 << 16


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed ids themselves, before ranking) and n of every document, end id included."""

    def one(batch: pa.RecordBatch) -> dict:
        ids = list(encode_in_parts(encoder(path), batch.column("text").to_pylist()))
        arrays = [np.frombuffer(x, dtype="<u4") for x in ids]
        return {"doc_id": batch.column("doc_id"), "n": [len(a) for a in arrays], "ids": [a.astype("<u2").tobytes() if a.max() < 65536 else b"\0" + a.tobytes() for a in arrays]}

    return arrow_map(docs_of(docs), one, "doc_id long, n long, ids binary")


def _raw(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype="<u2").astype("<u4") if len(x) == 2 * n else np.frombuffer(x[1:], dtype="<u4")


def frequency_ranks(encoded: DataFrame) -> np.ndarray:
    """ids in descending frequency (ties by id); a table of the vocabulary's size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            short, long = [], []
            for x, n in zip(b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True):
                (short if len(x) == 2 * n else long).append(x)
            c = np.bincount(np.frombuffer(b"".join(short), dtype="<u2"), minlength=1 << 16)
            for x in long:
                more = np.bincount(np.frombuffer(x[1:], dtype="<u4"))
                c = np.pad(c, (0, max(0, len(more) - len(c))))
                c[: len(more)] += more
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "c": pa.array(total[at], pa.int64())})

    rows = encoded.select("ids", "n").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.c, r.id))], dtype="<u4")


def write_files(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Encode ``docs`` into files of blocks in ascending doc_id order; returns the folder.

    Two passes: ids are written once, unordered; then ranked, put in order by range and packed. The folder holds
    ``blocks`` (part, ahead, doc_ids, counts, control, data; ahead: the part's tokens before the block) and ``ranks`` (the ids in frequency order).
    """
    spark, folder = docs.sparkSession, folder or work_dir(docs.sparkSession)
    encoded = materialize(encode_table(docs, path), folder, "zstd")
    ids = frequency_ranks(encoded)
    spark.createDataFrame([(ids.tobytes(),)], "ranks binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(ids.max(initial=0)) + 1, dtype="<u4")
    rank[ids] = np.arange(len(ids), dtype="<u4")
    sent = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, ahead = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, ahead
            control, data = pack(np.concatenate([sent.value[_raw(x, n)] for _, n, x in held]))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ahead": pa.array([ahead], pa.int64()), "doc_ids": pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), "counts": pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})
            held, size, ahead = [], 0, ahead + size
            return row

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                held.append(row)
                size += row[1]
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").select("doc_id", "n", "ids")
    ordered.mapInArrow(blocks, "part int, ahead long, doc_ids array<long>, counts array<long>, control binary, data binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_files(spark, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) and n_tokens of every document, decoded from the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    ranks = np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").first().ranks), dtype="<u4")
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}  # one row per file
    base, offset = 0, {}
    for part in sorted(totals):
        offset[part] = base
        base += totals[part]
    sent = spark.sparkContext.broadcast((ranks, offset))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks, offset = sent.value
            for part, ahead, docs, counts, control, data in zip(*(b.column(c).to_pylist() for c in ("part", "ahead", "doc_ids", "counts", "control", "data")), strict=True):
                at = offset[part] + ahead
                n = np.array(counts, dtype=np.int64)
                ids = ranks[unpack(control, data, int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(at + ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array([ids[e - c : e].tobytes() for e, c in zip(ends, n, strict=True)], pa.binary())})

    return blocks.select("part", "ahead", "doc_ids", "counts", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of decoded documents."""

    def one(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("doc_id", "start", "n_tokens")} | {"ids_crc32": [zlib.crc32(x) for x in batch.column("ids").to_pylist()]}

    return arrow_map(decoded, one, "doc_id long, start long, n_tokens long, ids_crc32 long")
