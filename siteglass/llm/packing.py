"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: among the waiting examples that fit, the one whose demand
vector has the largest dot product with the room that is left (both as shares of the limits) goes in next. Where
examples may be cut and none fits, the best one is cut to fill the sequence. Of equal products the example in the lowest
slot of the pool goes in. Every task packs what it reads, through a pool of bounded size, so no row waits for another
task; which examples share a sequence therefore follows from how the input is split.

Documents are cut freely; every token but a piece's first bears loss. Conversations are examples whose turns stay
together, and roles tell which tokens bear loss, so there the three limits bind independently.

An example without tokens takes no place and is left out; one that breaks a limit on its own and may not be cut
raises. Null text is empty (the end id alone). Repeated rows are packed as often as they come, an empty table gives no
rows, and columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, small_batches
from .tokens import encode_in_parts, encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 6
    loss: int = 1024


class Packer:
    """Packs a stream of (key, start, tokens, loss) into (sequence, offset, key, start, tokens, loss).

    A loss of None stands for examples whose every token but a segment's first bears loss.
    """

    def __init__(self, limits: Limits, cut: bool, pool: int = 512):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.size = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.key: list = [None] * pool
        self.start = np.zeros(pool, dtype=np.int64)
        self.length = np.zeros(pool, dtype=np.int64)
        self.loss = np.zeros(pool, dtype=np.int64)
        self.free = list(range(pool))
        self.made = 0

    def add(self, key, start: int, tokens: int, loss: int | None = None) -> Iterator[tuple]:
        if not tokens:
            return
        cap = min(self.limits.tokens, self.limits.loss + 1) if self.cut and loss is None else self.limits.tokens
        while self.cut and loss is None and tokens >= cap:  # full sequences by themselves
            yield self.made, 0, key, start, cap, cap - 1
            self.made, start, tokens = self.made + 1, start + cap, tokens - cap
        if not tokens:
            return
        lost = tokens - 1 if loss is None else loss
        if tokens > self.limits.tokens or lost > self.limits.loss:
            raise ValueError(f"example {key!r} breaks a limit on its own")
        if not self.free:
            yield from self.fill(self.limits.tokens)
        at = self.free.pop()
        self.key[at], self.start[at], self.length[at], self.loss[at] = key, start, tokens, lost

    def fill(self, tokens: int) -> Iterator[tuple]:
        """Close one sequence of at most ``tokens`` tokens."""
        room = np.array([tokens, self.limits.segments, self.limits.loss], dtype=float)
        offset = 0
        while room[0] > 0 and room[1] > 0:
            fits = (self.length > 0) & (self.length <= room[0]) & (self.loss <= room[2])
            weight = room / self.size / self.size
            dot = self.length * weight[0] + weight[1] + self.loss * weight[2]
            if fits.any() and not (self.cut and room[1] == 1 and (self.length >= room[0]).any()):
                at = int(np.argmax(np.where(fits, dot, -1)))
                take = int(self.length[at])
            elif self.cut and (self.length > 0).any():
                at = int(np.argmax(np.where(self.length > 0, dot, -1)))
                take = int(min(self.length[at], room[0], room[2] + 1))
            else:
                break
            if take <= 0:
                break
            whole = take == self.length[at]
            lost = int(self.loss[at]) if whole else take - 1
            yield self.made, offset, self.key[at], int(self.start[at]), take, lost
            offset += take
            room -= (take, 1, lost)
            self.start[at] += take
            self.length[at] -= take
            self.loss[at] = max(0, self.length[at] - 1) if not whole else 0
            if whole:
                self.key[at] = None
                self.free.append(at)
        self.made += 1

    def finish(self) -> Iterator[tuple]:
        """Empty the pool; with cuts, the last tokens fill sequences of a power of two each, without padding."""
        while (left := int(self.length.sum())) > 0:
            yield from self.fill(min(self.limits.tokens, 1 << left.bit_length() - 1) if self.cut else self.limits.tokens)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, limits: Limits | None = None) -> DataFrame:
    """Tokenize documents and pack their pieces; one row a piece, sequence ids are unique over all tasks."""
    limits = limits or Limits()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, enc = Packer(limits, cut=True), encoder(path)
        out: list[tuple] = []

        def put(pieces: Iterator[tuple]) -> None:
            for seq, offset, (doc, n, first, ids), start, length, _ in pieces:
                out.append((doc, start, length, zlib.crc32(ids[4 * (start - first) : 4 * (start - first + length)]), n, base + seq, offset))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(arrow, cols, strict=True)], schema=arrow)
            out.clear()
            return batch

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode_in_parts(enc, b.column("text").to_pylist()), strict=True):
                n = len(ids) // 4
                whole = n - n % limits.tokens
                put(packer.add((doc, n, 0, ids), 0, whole))
                if n > whole:
                    put(packer.add((doc, n, whole, ids[4 * whole :]), whole, n - whole))
                if len(out) >= 20_000:
                    yield rows()
        put(packer.finish())
        yield rows()

    return docs_of(docs).mapInArrow(run, SCHEMA)


CHAT = "conv_id long, turn long, start long, length long, loss long, ids_crc32 long, turn_tokens long, sequence_id long, offset long"
CHUNK = 16


def pack_conversations(turns: DataFrame, path: str, limits: Limits | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Tokenize the turns (conv_id, turn, role, text) of conversations and pack them; one row a piece of a turn.

    An example is a stretch of consecutive turns of one conversation that keeps every limit; a longer conversation makes
    several, cut between turns, and a turn that breaks a limit on its own is cut into pieces. Stretches also end after
    ``CHUNK`` turn numbers, by which rows are dealt, so a conversation of any length is spread over tasks. Tokens of
    the roles in ``trained`` bear loss, each turn's end id included. Rows with a null conv_id make a conversation, those
    with a null turn come first in it, a null role bears no loss.
    """
    limits = limits or Limits(2048, 8, 1024)
    small_batches(turns.sparkSession)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, enc = Packer(limits, cut=False), encoder(path)
        out: list[tuple] = []
        held: list[tuple] = []  # pieces of the example at hand: conversation, turn, start, ids, tokens of the turn, loss
        of, tokens, loss = None, 0, 0

        def close() -> None:
            nonlocal held, tokens, loss
            for seq, offset, pieces, *_ in packer.add(tuple(held), 0, tokens, loss) if held else ():
                put(seq, offset, pieces)
            held, tokens, loss = [], 0, 0

        def put(seq: int, offset: int, pieces: tuple) -> None:
            for conv, turn, start, ids, n, lost in pieces:
                out.append((conv, turn, start, len(ids) // 4, lost, zlib.crc32(ids), n, base + seq, offset))
                offset += len(ids) // 4

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 9
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in CHAT.split(", ")])

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("conv_id", "chunk", "turn", "role"))
            for conv, chunk, turn, role, ids in zip(*columns, encode_in_parts(enc, b.column("text").to_pylist()), strict=True):
                bears, n = role in trained, len(ids) // 4
                most = min(limits.tokens, limits.loss) if bears else limits.tokens
                for start in range(0, n, most):
                    piece = ids[4 * start : 4 * (start + most)]
                    size = len(piece) // 4
                    lost = size if bears else 0
                    if of != (conv, chunk) or tokens + size > limits.tokens or loss + lost > limits.loss:
                        close()
                        of = (conv, chunk)
                    held.append((conv, turn, start, piece, n, lost))
                    tokens, loss = tokens + size, loss + lost
                if len(out) >= 20_000:
                    yield rows()
        close()
        for seq, offset, pieces, *_ in packer.finish():
            put(seq, offset, pieces)
        yield rows()

    text = F.coalesce(F.col("text"), F.lit(""))
    told = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / CHUNK).cast("long").alias("chunk"), "role", text.alias("text"))
    dealt = told.repartition(parts, "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")
    return dealt.mapInArrow(run, CHAT)
