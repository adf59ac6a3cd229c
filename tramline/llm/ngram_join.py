"""N-gram Jaccard self-join by PartEnum signatures, exact.

Sets of word shingles are grouped in bands of similar size (a factor of two; sets near a border
are in both).  In a band the feature domain is cut into partitions, half as many as the largest
set has features.  Two sets with Jaccard >= 3/4 differ in at most a seventh of their joint
size, so all but that many partitions hold the same features in both: enumerating, in one
global order, one partition more than may differ gives similar sets a common signature.
Partitions made of corpus-wide frequent shingles come last in that order.

Every set enumerates a quarter more than that, so sets that link have many signatures in
common, and a set that shares fewer, say by a common passage, is done.  The signatures that
several of the others share give candidates.  First each set is checked against the one
set it shares most signatures with; sets found connected need no further check.  The rest are
compared across components: parity sketches bound the difference of two sets from below, so
only pairs that may link leave a task.  Verification compares whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, settle, table, tidy
from .graph import components

SHINGLE = 5
#: Sets up to this size use one partition per feature.
SMALL = 64
#: Documents sampled for frequent shingles, and in how many of them a frequent one occurs.
SAMPLE, FREQUENT = 2_000, 4
MOST_FREQUENT = 50_000
#: Bits of the filter of sets to be verified (a fixed size).
FILTER_BITS = 1 << 22

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D, 0x1B03738712FAD5C9, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes of text shingled at once.
TEXT_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A value per byte, that of a-z for A-Z.
_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * _M3)
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


_UP, _DOWN = _powers(_BASE, TEXT_BYTES), _powers(pow(_BASE, -1, 1 << 64), TEXT_BYTES)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of each word of the texts in ``data``, and how many words lie before each offset."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = (_UP[:n], _DOWN) if n <= TEXT_BYTES else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    value = _BYTE[data]
    value *= up
    total = np.cumsum(value)
    word = ~_IS_BLANK[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return scramble((total[end] - total[begin] + value[begin]) * down[begin]), np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a null text is empty."""
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, "right")) - 1 - at)
        h, until = _word_hashes(data[offsets[at] : offsets[at + n]], offsets[at : at + n + 1] - offsets[at])
        rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k, c in enumerate(_STEPS):
            rolled += h[k : k + len(rolled)] * c
        rolled = scramble(rolled)
        for begin, stop in zip(until[:-1].tolist(), until[1:].tolist(), strict=True):
            count = stop - begin
            if count >= SHINGLE:
                s = np.sort(rolled[begin : stop - SHINGLE + 1])
                new = np.concatenate(([True], s[1:] != s[:-1]))
                yield s if new.all() else s[new]
            else:
                out = np.array([count], np.uint64)
                for k in range(begin, stop):
                    out = scramble(out * _M3 + h[k : k + 1])
                yield out if count else np.empty(0, np.uint64)
        at += n


def _partitions(s: np.ndarray, band: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each non-empty partition of a sorted set, and whether it holds frequent features only."""
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
    if band == 0:
        return scramble(s ^ _M3), often
    cell = ((s >> np.uint64(32)) * np.uint64(1 << (band - 1))) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    total = np.add.reduceat(scramble(s + _M3), first)
    return scramble(total ^ scramble(cell[first] * _M2 + np.uint64(band))), np.logical_and.reduceat(often, first)


def surplus(n: int) -> int:
    """Signatures that a set of n features enumerates beyond those needed for one in common."""
    return (n // 4 + 1) // 4


def _bands(n: int) -> list[tuple[int, int]]:
    """(band, signatures needed for one in common) of a set of n features."""
    largest = n * 4 // 3  # of a set that may link
    own = 0 if n <= SMALL else max(7, (n - 1).bit_length())
    top = SMALL if own == 0 else 1 << own
    out = [(own, n - -(-3 * n // 4) + 1 if own == 0 else (n + min(largest, top)) // 7 + 1)]
    if largest > top:
        out.append((own + 1 if own else 7, (n + largest) // 7 + 1))
    return out


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a sorted set for similarity 3/4: a linking set has at least ``least_common`` of them."""
    if not len(s):
        return np.empty(0, np.uint64)
    out = []
    for band, need in _bands(len(s)):
        sig, often = _partitions(s, band, frequent)
        if len(sig) < need:  # too few partitions are filled: a signature that all such sets share
            sig = np.append(sig, scramble(np.array([band], np.uint64) + _M1))
        elif len(sig) > (take := need + max(0, surplus(len(s)) - 1)):
            order = (sig >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))
            sig = sig[np.argpartition(order, take - 1)[:take]]
        out.append(sig)
    return np.concatenate(out)


def least_common(s: np.ndarray) -> int:
    """How many signatures a set has in common with any set that links: its own surplus or that of the smallest partner.

    A set that enumerates all of its partitions keeps every common one that its partner
    enumerates, so only its own filled partitions can lower the number.
    """
    n = len(s)
    out = surplus(-(-3 * n // 4))
    for band, need in _bands(n):
        filled = n
        if band:
            cell = ((s >> np.uint64(32)) * np.uint64(1 << (band - 1))) >> np.uint64(32)
            filled = 1 + int(np.count_nonzero(cell[1:] != cell[:-1]))
        out = min(out, max(1, filled - need + 1))
    return max(1, out)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """(id, n, key, common): set size, a 128-bit name of the set, and its ``least_common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), hashlib.md5(s.tobytes()).digest(), least_common(s) if len(s) else 1) for s in shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))]], ["id", "n", "key", "common"])

    return docs.mapInArrow(tidy(run), "id long, n long, key binary, common long")


def frequent_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles found in several of about ``SAMPLE`` documents; any choice keeps the join exact."""
    share = min(1.0, SAMPLE / max(1, n_docs))
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = list(shingle_sets(b.column(1).slice(at, 200)))
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = sample.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def signature_rows(docs: DataFrame, frequent: np.ndarray, first: DataFrame) -> DataFrame:
    """(sig, id) of one document per set (``first``); equal sets are linked by their key.

    A fixed-size filter leaves out most other documents; those that pass cost rows, not results.
    """
    packed, wanted = frequent.tobytes(), _filter_of(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = np.frombuffer(packed, np.uint64), set()
        for b in batches:
            b = b.filter(pa.array([bool(wanted[p >> 3] >> (p & 7) & 1) for p in b.column(2).to_pylist()], pa.bool_()))
            sigs, ids, held = [], [], 0
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                name = hashlib.md5(s.tobytes()).digest()
                if i is None or name in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                sig = signatures(s, often)
                sigs.append(sig)
                ids.append(np.full(len(sig), i, np.int64))
                held += len(sig)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "id"])
                    sigs, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "id"])

    return _with_bit(docs).mapInArrow(tidy(run), "sig long, id long")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, id, head): rows of signatures that two or more sets have; head is the smallest of their ids.

    A streaming pass over sorted rows: no group is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_id = head = None  # the row that waits for its successor
        several = False

        def batch(s, i, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(i, pa.int64()), pa.array(h, pa.int64())], ["sig", "id", "head"])

        for b in batches:
            s, i = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if last_sig is not None:
                s, i = np.concatenate(([last_sig], s)), np.concatenate(([last_id], i))
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])))
            s, i = s[new], i[new]
            first = np.concatenate(([True], s[1:] != s[:-1]))
            heads = i[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
            if last_sig is not None:
                heads[s == last_sig] = head
            before = ~first
            if last_sig is not None:
                before[0] = several
            after = np.concatenate((~first[1:], [False]))
            keep = before | after
            last_sig, last_id, head, several = s[-1], i[-1], heads[-1], bool(before[-1])
            keep[-1] = False
            if keep.any():
                yield batch(s[keep], i[keep], heads[keep])
        if several:
            yield batch([last_sig], [last_id], [head])

    return rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(tidy(run), "sig long, id long, head long")


def _with_bit(docs: DataFrame) -> DataFrame:
    return docs.filter("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))


def _filter_of(ids: DataFrame) -> bytes:
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("b"))
    rows = bits.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS int)))").alias("v")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["w"] * 4 : r["w"] * 4 + 4] = r["v"].to_bytes(4, "little")
    return bytes(out)


def _wanted(docs: DataFrame, ids: DataFrame, make, schema: str, name: str, kind: pa.DataType) -> DataFrame:
    """(id, <made from the set>) of the documents asked for; a fixed-size filter spares the others the shuffle."""
    wanted = _filter_of(ids)
    columns = ["id", *name.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([bool(wanted[p >> 3] >> (p & 7) & 1) for p in b.column(2).to_pylist()], pa.bool_()))
            for at in range(0, b.num_rows, 200):
                g = b.slice(at, 200)
                out = [(i, *make(s)) for i, s in zip(g.column(0).to_pylist(), shingle_sets(g.column(1)), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *kind), strict=True)], columns)

    return _with_bit(docs).mapInArrow(tidy(run), schema)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, features) of the documents asked for, and of some others."""
    return _wanted(docs, ids, lambda s: (s.tobytes(),), "id long, features binary", "features", (pa.binary(),))


def parity(s: np.ndarray) -> np.ndarray:
    """Parities of a set's bucket counts, two to four buckets per feature.

    Two sets' parities differ in at most as many bits as the sets differ in features, whatever
    the number of buckets; halves of a sketch XOR to the sketch of half the size.
    """
    bits = 1 << max(7, (len(s) - 1).bit_length() + 1) if len(s) else 128
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketches_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, sketch) of the documents asked for, and of some others."""
    return _wanted(docs, ids, lambda s: (len(s), parity(s).tobytes()), "id long, n long, sketch binary", "n sketch", (pa.int64(), pa.binary()))


#: Rows of one head that one task takes; a head with more is split by signature.
HEAD_ROWS = 5_000
#: Rows of a signature compared in one block; larger groups are cut into pairs of blocks.
BLOCK = 512
#: Largest group whose pairs are named one by one.
FEW = 32


def _near(ids, comps, sizes, sides, sketches) -> set[tuple[int, int]]:
    """Pairs of a block pair in different components whose sketches don't rule a link out."""
    out: set[tuple[int, int]] = set()
    lengths = np.array([len(x) for x in sketches])
    for length in np.unique(lengths):
        for other in (length, 2 * length):
            mine, theirs = np.flatnonzero(lengths == length), np.flatnonzero(lengths == other)
            if not len(theirs):
                continue
            x = np.stack([sketches[k] for k in mine])
            y = np.stack([sketches[k] for k in theirs])
            if other > length:
                y = y[:, :length] ^ y[:, length:]
            n, c, side, i = sizes[theirs], comps[theirs], sides[theirs], ids[theirs]
            for row, k in zip(x, mine, strict=True):
                apart = np.bitwise_count(row ^ y).sum(1, dtype=np.int64)
                good = (7 * apart <= n + sizes[k]) & (c != comps[k]) & ((side != sides[k]) | (side == 2)) & (4 * np.minimum(n, sizes[k]) >= 3 * np.maximum(n, sizes[k]))
                if other == length:
                    good &= i < ids[k]
                out.update((max(int(ids[k]), int(j)), min(int(ids[k]), int(j))) for j in i[good])
    return out


def _tasks(df: DataFrame) -> int:
    """Tasks of a step whose rows are few bytes but much work: a number that Spark does not lower by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _parted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``: signatures of a head that has many rows are dealt to several tasks."""
    hot = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAD_ROWS).select("head", F.ceil(F.col("n") / HEAD_ROWS).alias("parts"))
    hot = settle(hot, "join-heads")  # a few rows, whose size the planner then knows
    return rows.join(hot, "head", "left").withColumn("part", F.pmod(F.xxhash64("sig"), F.coalesce("parts", F.lit(1)))).drop("parts")


def _large_groups(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Cross-component pairs of large groups: whole groups compared as sketches, in blocks of bounded size."""
    rows = _parted(rows).withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(sketches, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.select("head", "sig", "part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "component", "n", side.alias("side"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sent = None, [], set()

        def flush() -> set[tuple[int, int]]:
            if len(held) < 2 or len({h[1] for h in held}) < 2:
                return set()
            i, c, n, s = (np.array([h[k] for h in held], np.int64) for k in range(4))
            return _near(i, c, n, s, [np.frombuffer(h[4], np.uint64) for h in held])

        for b in batches:
            pairs: set[tuple[int, int]] = set()
            cols = [b.column(k).to_pylist() for k in (1, *range(3, 10))]
            for sig, lo, hi, i, c, n, side, sketch in zip(*cols, strict=True):
                if key != (sig, lo, hi):
                    pairs |= flush()
                    key, held = (sig, lo, hi), []
                held.append((i, c, n, side, sketch))
            pairs -= sent
            sent |= pairs
            if len(sent) > 200_000:
                sent.clear()
            if pairs:
                yield _pairs(pairs)
        if last := flush() - sent:
            yield _pairs(last)

    return rows.repartition(_tasks(rows), "head", "part", "lo", "hi").sortWithinPartitions("head", "sig", "lo", "hi").mapInArrow(tidy(run), "a long, b long")


def _pairs(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _small_groups(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Cross-component pairs of groups of at most ``FEW`` sets; a pair is named once per task, then compared as sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sent = None, [], set()
        fresh: list[tuple[int, int]] = []

        def flush() -> None:
            for k, (i, c) in enumerate(held):
                for j, d in held[:k]:
                    if c != d and (p := (max(i, j), min(i, j))) not in sent:
                        sent.add(p)
                        fresh.append(p)

        for b in batches:
            for sig, i, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if sig != key:
                    flush()
                    key, held = sig, []
                held.append((i, c))
            if fresh:
                yield _pairs(fresh)
                fresh = []
            if len(sent) > 200_000:
                sent.clear()
        flush()
        if fresh:
            yield _pairs(fresh)

    named = _parted(rows).select("head", "sig", "id", "component", "part").repartition(_tasks(rows), "head", "part").sortWithinPartitions("head", "sig").mapInArrow(tidy(run), "a long, b long").distinct()
    left = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append(7 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= n + m)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    sized = named.join(left, "a").join(right, "b").filter("4 * na >= 3 * nb AND 4 * nb >= 3 * na")
    return sized.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(near), "a long, b long")


def cross_candidates(open_rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a > b) in different components that share a signature and may link.

    Every pair of a group is looked at, but only as sketches and only across components.  Rows
    of groups with the same smallest id, mostly signatures of one family, meet in one task, so that a
    pair is named once; those of a large family are dealt to several by their signature.
    """
    rows = open_rows.join(open_rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size")), "sig")
    few, many = rows.filter(F.col("size") <= FEW), rows.filter(F.col("size") > FEW)
    return _small_groups(few, sketches).unionAll(_large_groups(many, sketches)).distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= 75 * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("features").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("features").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def _best(candidates: DataFrame) -> DataFrame:
    """Each id's partner with the most common signatures."""
    counted = candidates.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct(F.col("n"), -F.col("b"))).alias("b")).select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(id, component) after two steps along the links; parts of one component may keep different labels."""
    one = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
    two = one.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return one.join(two, F.col("b") == F.col("_a"), "left").select(F.col("a").alias("id"), F.coalesce("_b", "b").alias("component"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, n) per row, (id, component) of every id that is linked with another).

    Rows with a null id, and texts without words, link with nothing; repeated ids are one
    document with several texts; an empty table gives empty results.
    """
    rows = _rows(docs, id_col, text_col)
    described = settle(describe(rows), "join-sets")
    filled = described.filter("n > 0 AND id IS NOT NULL")
    first = settle(filled.groupBy("key", "n").agg(F.min("id").alias("b")), "join-first")
    copies = filled.join(first, ["key", "n"]).select(F.col("id").alias("a"), "b").filter("a <> b")
    frequent = frequent_shingles(rows, described.count())
    found = settle(shared_signatures(signature_rows(rows, frequent, first.select(F.col("b").alias("id")))), "join-all-shared")
    enough = filled.groupBy("id").agg(F.min("common").alias("common")).join(found.groupBy("id").agg(F.count(F.lit(1)).alias("shared")), "id").filter("shared >= common")
    shared = settle(found.join(enough.select("id"), "id", "left_semi"), "join-shared")
    forget(found)
    links = copies
    checked = None
    for step in range(3):
        if step == 0:
            todo = _best(shared.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
        else:
            named = shared.join(_labels(links) if step == 1 else components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "id").alias("first")).filter("lo <> hi")
            open_rows = settle(named.join(mixed.select("sig", "first"), "sig").select("sig", "id", "head", "component", "first"), "join-open")
            if step == 1:
                pairs = open_rows.filter("component <> first").select(F.col("id").alias("a"), F.col("head").alias("b"))
            else:
                sketches = settle(sketches_of(rows, open_rows.select("id").distinct()), "join-sketches")
                pairs = cross_candidates(open_rows, sketches)
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
            todo = _best(pairs) if step == 1 else pairs
        todo = settle(todo, "join-pairs")
        checked = todo if checked is None else checked.unionAll(todo)
        ids = todo.select(F.col("a").alias("id")).unionAll(todo.select(F.col("b").alias("id"))).distinct()
        links = links.unionAll(settle(verify(todo, sets_of(rows, ids)), "join-links"))
    forget(shared)
    return described.select("id", "n"), components(links)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked with one of a smaller id, directly or over others."""
    _, found = link_documents(docs, id_col, text_col)
    others = found.filter("id <> component").select(F.col("id").alias(id_col))
    return docs.join(others, id_col, "left_anti")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component (smallest doc_id reachable by links) of every document."""
    rows, found = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
