"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over the histogram of piece lengths (at most ``CAPACITY`` rows), not over
documents: lengths in descending order, each count placed into the fullest sequences that still
have room.  The plan is a list of runs: pieces of one length with ranks lo..hi go to consecutive
sequences.  Pieces then find their run by joining on (length, rank).  Ranks within a length are
numbered per input partition and shifted by the counts of earlier partitions, so no length,
however frequent, passes through one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, tidy

CAPACITY = 4096
#: Id appended to every document.
END = 1
#: Letter runs that a worker's cache may hold.
CACHE_WORDS = 200_000

_caches: dict[str, WordCodes] = {}


#: Punctuation that may follow a run of letters in a word encoded by parts.
_TAIL = ".,;:!?#*%&$|)"
_PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[.,;:!?#*%&$|)]*$"
_RUN = r"^[^.,;:!?#*%&$|)]+"
#: Letter runs encoded in one call, with blanks between them; bytes of text handled at once.
TOGETHER, TEXT_BYTES = 5000, 2 << 20


class WordCodes:
    """Encodes texts word by word: this tokenizer never merges across white space.

    The distinct words of a few megabytes of text are found by Arrow.  A plain word, Latin-1
    letters with ASCII punctuation behind, is looked up as lower-case letters and punctuation;
    new letter runs are encoded together and cut at their end-of-word ids.  Any other word is
    encoded as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), TOGETHER):
            group = new[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(group):
                raw = ids.tobytes()
                found = [raw[4 * p : 4 * q] for p, q in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                found = self._whole(group)
            self.letters.update(zip(group, found, strict=True))

    def _parts(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Codes, and the two of them that each distinct word consists of."""
        if len(self.letters) > CACHE_WORDS:
            self.letters.clear()
        plain = pc.match_substring_regex(words, _PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        runs = pc.utf8_rtrim(low, _TAIL).dictionary_encode()
        tails = pc.replace_substring_regex(low, _RUN, "").dictionary_encode()
        names, letters = runs.dictionary.to_pylist(), self.letters
        self._learn([r for r in names if r not in letters])
        codes = [letters[r] for r in names]
        first = len(codes)
        codes += self._whole(tails.dictionary.to_pylist())
        second = len(codes)
        codes += self._whole(words.filter(pc.invert(plain)).to_pylist())
        of = np.full((len(words), 2), len(codes), np.int64)
        codes.append(b"")
        mask = plain.to_numpy(zero_copy_only=False)
        of[mask, 0] = runs.indices.to_numpy(zero_copy_only=False)
        of[mask, 1] = tails.indices.to_numpy(zero_copy_only=False) + first
        of[~mask, 0] = np.arange(len(codes) - 1 - second) + second
        return codes, of

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a null text has none."""
        at = 0
        while at < len(texts):
            size, n = 0, 0
            while at + n < len(texts) and (not n or size < TEXT_BYTES):
                size += len(texts[at + n].as_buffer() or b"") if texts[at + n].is_valid else 0
                n += 1
            lists = pc.ascii_split_whitespace(texts.slice(at, n).fill_null(""))
            found = lists.flatten().dictionary_encode()
            codes, parts = self._parts(found.dictionary)
            pool = np.frombuffer(b"".join(codes), "<u4")
            lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            starts = np.cumsum(lengths) - lengths
            used = parts[found.indices.to_numpy(zero_copy_only=False)].ravel()
            each = lengths[used]
            ends = np.cumsum(each)
            ids = pool[np.repeat(starts[used] - ends + each, each) + np.arange(ends[-1])] if len(used) else pool
            until = np.concatenate(([0], ends))[2 * np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            begin = 0
            for stop in until.tolist():
                yield ids[begin:stop]
                begin = stop
            at += n


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with a running number per (input partition, length).

    A null or empty text is the end id alone; null ids and repeated rows are packed like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        if path not in _caches:
            _caches[path] = WordCodes(path)
        codes, part, end = _caches[path], TaskContext.get().partitionId(), np.array([END], "<u4")
        places: Counter = Counter()
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), codes.encode(b.column(1)), strict=True):
                ids = np.append(ids, end)
                for k in range(0, len(ids), capacity):
                    cut = ids[k : k + capacity]
                    n = len(cut)
                    out.append((doc, k // capacity, k, n, zlib.crc32(cut), part, places[n]))
                    places[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECE)


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, lo, hi, sequence, per_sequence, offset).

    The piece of rank r in lo..hi-1 goes to ``sequence + (r - lo) // per_sequence`` at
    ``offset + (r - lo) % per_sequence * length``.  Sequences with equal room are kept as
    intervals; a length splits at most two of them, so there are at most 3 * capacity intervals,
    and one sequence holds fewer than sqrt(2 * capacity) different lengths: the number of runs
    is bounded by the capacity alone (about 1.1 million rows at 4096), whatever the corpus.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[int] = []  # sorted rooms that have intervals
    intervals: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def give(r: int, first: int, count: int) -> None:
        if r and count:
            if r not in intervals:
                intervals[r] = []
                insort(room, r)
            intervals[r].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                r = room[at]
                first, count = intervals[r].pop()
                if not intervals[r]:
                    del intervals[r]
                    room.pop(at)
            else:
                r, first = capacity, used
                count = -(-left // (capacity // length))
                used += count
            each = r // length
            full = min(count, left // each)
            for sequences, per in ((full, each), (1 if full < count and left - full * each else 0, min(each, left - full * each))):
                if sequences and per:
                    runs.append((length, rank, rank + sequences * per, first, per, capacity - r))
                    give(r - per * length, first, sequences)
                    rank, left, first, count = rank + sequences * per, left - sequences * per, first + sequences, count - sequences
            give(r, first, count)
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity`` ids.

    The piece table is written once to the shared folder, so ranks, plan and result come from
    the same rows even if an executor is lost.
    """
    spark = docs.sparkSession
    pieces = settle(tokenize_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan_runs(histogram, capacity), "length long, lo long, hi long, first long, per long, base long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("rank", F.col("shift") + F.col("place"))
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(runs["length"])
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"), (F.col("base") + step % F.col("per") * F.col("length")).alias("offset")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens.

    A null or empty text is the end id alone; null ids and repeated rows are packed like others; of equal lengths any order
    will do, ranks follow the partitions of the written pieces; an empty table gives no rows.
    """
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
