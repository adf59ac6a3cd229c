"""Bounded-space online packing: a fixed number of open windows per partition, best-fit, leftovers merged.

Each task keeps at most ``OPEN`` windows.  A piece goes to the open window with the least room that holds
it; if none does and no window may be opened, the fullest is filled with the piece's head and leaves, and
the rest is placed again.  What is open when a partition ends travels with its ids (a bounded amount) to a
task that merges the windows of ``FAN`` partitions in the same way, and so on until one set is left, which
is cut into full sequences and powers of two: sequences of such lengths need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ByteCodes, gather, split
from .common import fresh, settle, table, tidy

CAPACITY = 1024
#: Id appended to every document.
END = 0
#: Windows open in a task; partitions (or sets of leftovers) whose leftovers one task merges.
OPEN, FAN = 32, 8
#: Distinct chunks a worker remembers, and their longest.
REMEMBERED, SHORT = 300_000, 64

#: A part of a document: id, place of its first id in it, its ids, ids of the whole document.
Part = tuple[int | None, int, np.ndarray, int]


class Windows:
    """Open windows of one task and the sequences that have left."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.open: dict[int, list[Part]] = {}
        self.next = 0
        self.full: list[list[Part]] = []

    def _cut(self, parts: list[Part], n: int) -> tuple[list[Part], list[Part]]:
        """The first n ids, and the others."""
        head: list[Part] = []
        for k, (doc, start, ids, total) in enumerate(parts):
            if n < len(ids):
                if n:
                    head.append((doc, start, ids[:n], total))
                return head, [(doc, start + n, ids[n:], total), *parts[k + 1 :]]
            head.append(parts[k])
            n -= len(ids)
        return head, []

    def place(self, parts: list[Part]) -> None:
        """Best-fit; what is longer than a window leaves in full ones first."""
        n = sum(len(p[2]) for p in parts)
        while n >= self.capacity:
            head, parts = self._cut(parts, self.capacity)
            self.full.append(head)
            n -= self.capacity
        while n:
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
                self.open[window] += parts
                if room > n:
                    insort(self.rooms, (room - n, window))
                else:
                    self.full.append(self.open.pop(window))
                return
            if len(self.rooms) < self.limit:
                self.open[self.next] = list(parts)
                insort(self.rooms, (self.capacity - n, self.next))
                self.next += 1
                return
            room, window = self.rooms.pop(0)
            head, parts = self._cut(parts, room)
            self.full.append(self.open.pop(window) + head)
            n -= room

    def leave(self) -> list[list[Part]]:
        """The full sequences so far, no longer kept."""
        out, self.full = self.full, []
        return out

    def close(self) -> list[list[Part]]:
        """All open windows as full sequences and powers of two."""
        rest = [p for _, window in self.rooms for p in self.open[window]]
        left = sum(len(p[2]) for p in rest)
        while left:
            head, rest = self._cut(rest, self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1))
            self.full.append(head)
            left -= sum(len(p[2]) for p in head)
        self.rooms, self.open = [], {}
        return self.leave()


class Encoder:
    """Ids of texts; short chunks that came before are remembered."""

    def __init__(self, path: str):
        self.codes, self.known = ByteCodes(path), {}

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        found, of, counts = split(texts, True, self.codes.special)
        names, known = found.to_pylist(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [c for c in names if c not in known]
        codes = dict(zip(new, self.codes.encode(new), strict=True))
        raw = [known.get(c) or codes[c] for c in names]
        known.update((c, codes[c]) for c in new if len(c) <= SHORT)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = gather(np.frombuffer(b"".join(raw), "<u4"), lengths, of)
        ends = np.concatenate(([0], np.cumsum(lengths[of])))[np.cumsum(counts)] if len(of) else np.zeros(len(counts), np.int64)
        begin = 0
        for stop in ends.tolist():
            yield ids[begin:stop]
            begin = stop


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, set int, ids binary"
_TYPES = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "set", "ids"), (*[pa.int64()] * 7, pa.int32(), pa.binary()), strict=True))
_encoders: dict[str, Encoder] = {}


def _rows(sequences: list[list[Part]], first: int, of_set: int, left: bool) -> pa.RecordBatch:
    """Rows of sequences numbered from ``first``; those left over keep their ids."""
    out = [
        (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), total, first + k, offset, of_set, ids.tobytes() if left else None)
        for k, parts in enumerate(sequences)
        for (doc, start, ids, total), offset in zip(parts, np.cumsum([0] + [len(p[2]) for p in parts[:-1]]).tolist(), strict=True)
    ]
    columns = zip(*out, strict=True) if out else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES.values(), strict=True)], list(_TYPES))


def _number(level: int, of_set: int, k: int) -> int:
    """Sequence ids: 4 bits of the level, 28 of the set, 31 within it."""
    return level << 59 | of_set << 31 | k


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_online(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = OPEN, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and gapless ``offset``.

    A null or empty text is the end id alone; null ids and repeated rows are packed like others, each by
    itself; an empty table gives no rows; other columns are not read.  Every table of pieces is written to
    the shared folder before it is read, so a lost executor changes no sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        part, end, made = TaskContext.get().partitionId(), np.array([END], "<u4"), 0
        space = Windows(capacity, windows)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), _encoders[path].encode(b.column(1)), strict=True):
                space.place([(doc, 0, np.append(ids, end), len(ids) + 1)])
            full = space.leave()
            yield _rows(full, _number(0, part, made), part, False)
            made += len(full)
        yield _rows([space.open[w] for _, w in space.rooms], 0, part, True)

    def merge(level: int, last: bool):
        def merged(key: tuple, group: pa.Table) -> pa.Table:
            of_set = key[0].as_py()
            space = Windows(capacity, windows)
            rows = group.sort_by([("set", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
            parts: list[Part] = []
            before = None
            for r in rows:
                if parts and (r["set"], r["sequence_id"]) != before:
                    space.place(parts)
                    parts = []
                before = r["set"], r["sequence_id"]
                parts.append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            space.place(parts)
            full = space.leave()
            full += space.close() if last else []
            done = _rows(full, _number(level, of_set, 0), of_set, False)
            return pa.Table.from_batches([done, _rows([space.open[w] for _, w in space.rooms], 0, of_set, True)])

        return merged

    one, two = fresh(docs, "id", "body")
    rows = docs.select(F.col(id_col).cast("long").alias(one), F.col(text_col).cast("string").alias(two))
    placed = settle(rows.mapInArrow(tidy(run), PLACED), "windows")
    done, sets, level = placed.filter("ids IS NULL"), (placed.agg(F.max("set")).first()[0] or 0) + 1, 0
    while True:
        level, sets = level + 1, -(-sets // FAN)
        group = F.floor(F.col("set") / FAN).cast("int")
        placed = settle(placed.filter("ids IS NOT NULL").groupBy(group).applyInArrow(merge(level, sets == 1), PLACED), "windows")
        done = done.unionByName(placed.filter("ids IS NULL"))
        if sets == 1:
            return done.drop("ids", "set")


def op11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens.

    A null or empty text is the end id alone; null ids and repeated rows are packed each; an empty table
    gives no rows.
    """
    return pack_online(table(spark, sf_dir, "documents"))
