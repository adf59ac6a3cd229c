"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick on folded text.

Folding lower-cases, drops marks that hide letters, maps look-alike letters to Latin ones and
digits or symbols inside words to the letters they stand for.  Lexicon entries are whole words
or word beginnings; a word scores its best entry.  The sum over a text, divided by the
logarithm of its length, is scaled so that the cutoff chosen on the training rows is 0.7.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, settle, table, tidy
from .fingerprint import shingle_hashes

#: Cyrillic, Greek and other letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏєкмтвпαεορνικτυχωɑɡıłøđ", "aeopcyxijsdhlekmtbnaeopviktuxwagilod", strict=True))
#: Digits and symbols that stand for letters inside words.
STANDS_FOR = str.maketrans("0134578@$!|", "oieastbasil")
#: Harmless phrases (folded) whose words never count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "village idiot", "stupid mistake")
#: Labelled rows used to learn the lexicon, at most about so many (chosen by a hash of doc_id).
TRAIN_ROWS = 12_000
#: Beginnings of words that may be entries, in letters, and the size of the lexicon.
PREFIXES = (4, 5, 6, 7)
LEXICON = 5_000

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k.upper()): v for k, v in LOOKALIKES.items() if k.upper() != k}
_FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_WIDE = re.compile(r"[Ͱ-ԯɑ-ɡ​-‍⁠﻿­！-～̀-ͯıłøđ]")
_STANDS = re.compile(r"[0-9@$!|]+")
_WORD = re.compile(r"[^\W\d_]+")


def _stand(m: re.Match) -> str:
    s, run = m.string, m[0]
    left = m.start() > 0 and s[m.start() - 1].isalpha()
    right = m.end() < len(s) and s[m.end()].isalpha()
    if right or run.isdigit() and left:
        return run.translate(STANDS_FOR)
    return run


def fold(text: str) -> str:
    """Lower-case text with look-alike letters and digit substitutions undone."""
    text = text.lower()
    if not text.isascii() and _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    return _STANDS.sub(_stand, text)


class Lexicon:
    """Entries: a word (``idiot ``, with a trailing blank) or the beginning of words (``idio``)."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.auto = ahocorasick.Automaton()
        for e, w in weights.items():
            self.auto.add_word(e.rstrip(" "), (len(e.rstrip(" ")), w if e.endswith(" ") else None, w if not e.endswith(" ") else None))
        for e, w in weights.items():  # an entry can be both a word and a beginning
            k = e.rstrip(" ")
            n, a, b = self.auto.get(k)
            self.auto.add_word(k, (n, weights.get(k + " ", a), weights.get(k, b)))
        if weights:
            self.auto.make_automaton()
        self.weights, self.exceptions = weights, [re.compile(r"\b" + re.escape(x).replace(r"\ ", r"\s+") + r"\b") for x in exceptions]
        self.first = tuple({x.split()[0] for x in exceptions})

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each matched word and its weight."""
        found: dict[int, float] = {}
        if not self.weights:
            return found
        for end, (n, word, begins) in self.auto.iter(folded):
            at = end - n + 1
            if at and folded[at - 1].isalpha():
                continue
            w = begins
            if word is not None and not (end + 1 < len(folded) and folded[end + 1].isalpha()):
                w = word if w is None else max(w, word)
            if w is not None and w > found.get(at, -1.0):
                found[at] = w
        if found and any(x in folded for x in self.first):
            for p in self.exceptions:
                for m in p.finditer(folded):
                    for at in [a for a in found if m.start() <= a < m.end()]:
                        del found[at]
        return found

    def raw(self, text: str | None) -> tuple[float, int]:
        """Weight per logarithm of the length, and the number of matched words."""
        if not text:
            return 0.0, 0
        found = self.hits(fold(text))
        if not found:
            return 0.0, 0
        return sum(found.values()) / math.log2(8.0 + len(text.split())), len(found)


def _features(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(fold(text))):
        out.add(w + " ")
        out.update(w[:k] for k in PREFIXES if len(w) >= k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["feature", "pos", "neg"])
        for c in counts:
            c.clear()
        return batch

    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            counts[1 if y else 0].update(_features(text.as_py() or ""))
        if len(counts[0]) + len(counts[1]) > 400_000:  # bounded memory whatever the partition holds
            yield out()
    if counts[0] or counts[1]:
        yield out()


def prune(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Weights of the entries (rows with, rows without the label, weight) that say something of their own."""
    longest = dict(found)
    for e, (pos, neg, _) in found.items():
        for k in range(PREFIXES[0], len(e.rstrip(" ")) + (e[-1] == " ")):
            if (s := found.get(e[:k])) and s[:2] == (pos, neg):
                longest.pop(e if e[-1] == " " else e[:k], None)
    for e, (pos, _, w) in list(longest.items()):  # a shorter entry that adds little but errors
        for k in range(PREFIXES[0], len(e.rstrip(" "))):
            if (s := longest.get(e[:k])) and pos >= 0.8 * s[0] and w > s[2]:
                del longest[e[:k]]
    out = {}
    for e, (pos, _, w) in longest.items():
        shorter = [longest[e[:k]] for k in range(PREFIXES[0], len(e.rstrip(" ")) + (e[-1] == " ")) if e[:k] in longest]
        if not any(s[0] > pos and s[2] >= w - 1.0 for s in shorter):
            out[e] = w
    return out


def learn(train: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS, size: int = LEXICON) -> tuple[dict[str, float], float]:
    """(lexicon, cutoff of the raw score) from labelled rows (``id``, text, label).

    Fitted on a sample of about ``max_rows`` rows, chosen by a hash of the id (all rows where
    there are fewer); texts that share their smallest shingle hash (copies, most near copies)
    count once.  A feature enters if its likelihood ratio passes
    a threshold that grows with the number of features tried; its weight is its smoothed
    log-odds.  Of entries that start alike and match the same rows the longest beginning stays;
    one that a shorter, more frequent entry explains is left out.  At most ``size``
    entries are kept, so what reaches the driver is bounded.
    """
    rows = train.select("id", F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND text IS NOT NULL")
    n = rows.select("id").count()
    share = min(1.0, max_rows / max(n, 1))
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    rows = settle(rows.groupBy(F.array_min(shingle_hashes(F.col("text")))).agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "toxic-train")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(v for k, v in total.items() if k), total.get(0, 0)
    if not n1 or not n0:
        forget(rows)
        return {}, 1.0
    counts = settle(rows.mapInArrow(tidy(_count), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    bound = 2.0 * math.log(max(2, counts.count()))
    p = n1 / (n1 + n0)
    c = F.col("pos") + F.col("neg")
    term = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (c * F.lit(q)))).otherwise(F.lit(0.0))
    odds = F.log((F.col("pos") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n0 + 1.0))
    best = (
        counts.filter(F.col("pos") >= 3)
        .withColumn("g", 2.0 * (term("pos", p) + term("neg", 1.0 - p)))
        .withColumn("w", odds)
        .filter((F.col("g") > bound) & (F.col("w") > 2.0) & (F.col("pos") >= 2 * F.col("neg")))
        .orderBy(F.desc("g"), "feature")
        .limit(size)
        .collect()
    )
    forget(counts)
    weights = prune({r["feature"]: (r["pos"], r["neg"], float(r["w"])) for r in best})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for b in batches:
            raw = [round(lexicon.raw(t.as_py())[0] * 50) / 50 for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column(1)], ["raw", "y"])

    grid = rows.mapInArrow(tidy(score), "raw double, y int").groupBy(F.least("raw", F.lit(20.0)).alias("raw")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("raw").collect()
    forget(rows)
    caught, alarms, cut, below, clean, most = n1, n0, 0.02, 0.0, 0.0, -1.0
    for r in grid:  # the cutoff with the best F1, half-way down to the highest clean score below
        if r["raw"] > 0 and (f1 := 2 * caught / max(1, caught + alarms + n1)) > most:
            most, cut, below = f1, r["raw"], clean
        caught, alarms = caught - r["pos"], alarms - (r["n"] - r["pos"])
        clean = r["raw"] if r["n"] > r["pos"] else clean
    return weights, max((cut + below) / 2.0, 0.005)


SCORED = "id long, score double, n_hits long"


def score_toxicity(docs: DataFrame, weights: dict[str, float], cutoff: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score in [0, 1), matched words) of every whole text; score 0.7 is the cutoff.

    Null and empty texts score 0; null ids, repeated rows and empty tables pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for b in batches:
            raw = [lexicon.raw(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r / (r + cutoff * 3.0 / 7.0) for r, _ in raw], pa.float64()), pa.array([k for _, k in raw], pa.int64())], ["id", "score", "n_hits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCORED)


def drop_toxic(docs: DataFrame, weights: dict[str, float], cutoff: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.7, all columns, without a shuffle."""
    at, names = docs.columns.index(text_col), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for b in batches:
            keep = pa.array([lexicon.raw(t.as_py())[0] < cutoff for t in b.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], names)

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id) -> F.Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic) of the labelled documents outside the holdout; labels are few and narrow, texts are filtered by them."""
    marked = labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(marked, "id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned outside the holdout only.

    Null and empty texts score 0; rows with a null id are scored and not held out; repeated rows score alike; without
    labels of both kinds every score is 0; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, cutoff = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, weights, cutoff)
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits"
    )
