"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule rejects a document whose measure lies above a cutoff.  The rules are tightened
together: levels 1, 2, ... name nested sets of cutoffs, from lenient to strict, and a level rejects
what any of its rules rejects.  On labelled documents of good quality that pass the base rules,
per stratum (language), the number of false rejections at a level is binomial; a level is usable
only if the exact (Clopper-Pearson) upper bound of its rate stays within ``RISK``.  As levels are
nested, testing them from lenient to strict and stopping at the first failure is one test per
stratum (fixed-sequence testing), and the bound holds for the union of the rules; the error level
is divided by the number of strata and one more for all strata together.  Of the usable levels the one is
taken that separates bad from good best.  A stratum with no usable level of its own takes the level
of all strata together, whose bound then holds for documents of all strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, settle, table, words

SYMBOLS = "#*$%&|<>"
#: Largest share of good documents that the rules together may reject in a stratum, and the overall error level.
RISK, LEVEL = 0.02, 0.05
#: Cutoffs per rule and level, in thousandths; a document is rejected above the cutoff.
CUTOFFS = {
    "symbols": (300, 200, 150, 100, 50, 20),
    "capitals": (700, 500, 300, 200, 120, 80),
    "dup_lines": (700, 500, 400, 300, 200, 100),
    "repeats": (400, 300, 250, 200, 150, 100),
    "long_words": (18000, 14000, 12000, 10000, 9000, 8000),
    "digits": (400, 300, 200, 150, 100, 50),
}
LEVELS = 6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(w: Column, width: int = 3) -> Column:
    """Words standing in ``width``-word windows that occur twice or more in the text."""
    windows = lambda a: F.transform(
        F.slice(a, 1, F.greatest(F.size(a) - width + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, width)])
    )

    def starts(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            ordered,
            lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda s, x: s + x
    )
    return let(let(w, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every whole text, one pass, no shuffle; a null text counts as empty."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "stratum", "t", let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("w"), let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))).alias("l"))
    bare = F.char_length(_without(t, SPACES))
    fewer = lambda chars: F.char_length(t) - F.char_length(_without(t, chars))
    return rows.select(
        "id",
        "stratum",
        F.col("w.n").cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        fewer(SYMBOLS).cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        fewer("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        fewer("0123456789").cast("long").alias("n_digits"),
    )


def rule_values() -> dict[str, Column]:
    """Each rule's measure in whole thousandths; 0 where it is undefined."""
    per = lambda a, b: F.coalesce(F.expr(f"{a} * 1000 div nullif({b}, 0)"), F.lit(0))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "capitals": per("n_capitals", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "digits": per("n_digits", "word_chars"),
    }


def within_risk(n: Column, k: Column, tests: Column, risk: float = RISK, level: float = LEVEL) -> Column:
    """Whether the exact upper bound of a rate seen k times in n stays within ``risk``: P(Bin(n, risk) <= k) <= level / tests."""
    odds = math.log(risk) - math.log1p(-risk)
    first = n * F.lit(math.log1p(-risk))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    below = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["s"]
    return F.when(k < n * F.lit(risk), below <= F.lit(level) / tests).otherwise(F.lit(False))


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def first_level(cutoffs=None) -> Column:
    """The most lenient level that rejects a document; one more than the last where none does."""
    passed = lambda v, cs: sum((F.when(v <= c, 1).otherwise(0) for c in cs), F.lit(1))
    return F.least(*[passed(v, (cutoffs or CUTOFFS)[r]) for r, v in rule_values().items()])


def choose_levels(measured: DataFrame, labels: DataFrame, cutoffs=None, risk: float = RISK, level: float = LEVEL) -> tuple[DataFrame, DataFrame]:
    """((stratum, level) of strata with a usable level, one row with the level of all together or null).

    ``labels`` has (id, quality); counting is one aggregation over the labelled rows, a row per
    (stratum, level) comes out.  A null stratum is a stratum of its own.  Without labels, or with
    labels of one kind only, no level is usable.
    """
    levels = len(next(iter((cutoffs or CUTOFFS).values())))
    marked = labels.filter("quality IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    rows = measured.filter(~failed_base()).join(marked, "id").select("stratum", "quality", first_level(cutoffs).alias("first"))
    seen = settle(rows.groupBy("stratum", "quality", "first").agg(F.count(F.lit(1)).alias("docs")), "quality-seen")
    strata = seen.select("stratum").distinct().agg((F.count(F.lit(1)) + 1).alias("tests"))
    at = seen.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).crossJoin(strata)  # one row: the number of tests
    total = lambda q, hit=F.lit(True): F.sum(F.when((F.col("quality") == q) & hit, F.col("docs")).otherwise(0))
    hit = F.col("first") <= F.col("level")

    def best(*by: str) -> DataFrame:
        cells = at.groupBy(*by, "level").agg(F.first("tests").alias("tests"), total(1).alias("n"), total(1, hit).alias("k"), total(0).alias("all_bad"), total(0, hit).alias("bad"))
        cells = cells.withColumn("gain", F.col("bad") * F.col("n") - F.col("k") * F.col("all_bad"))
        usable = cells.filter((F.col("gain") > 0) & within_risk(F.col("n"), F.col("k"), F.col("tests"), risk, level))
        return usable.groupBy(*by).agg((-F.max(F.struct("gain", (-F.col("level")).alias("x")))["x"]).alias("level"))

    return best("stratum"), best()


def judge(measured: DataFrame, chosen: DataFrame, together: DataFrame) -> DataFrame:
    """``measured`` plus ``rejected_by``: the rules whose cutoff at the level of the document's stratum it exceeds."""
    own = chosen.select(F.col("stratum").alias("of"), F.col("level").alias("own"))
    rows = measured.join(own, F.col("stratum").eqNullSafe(F.col("of")), "left").crossJoin(together.select(F.col("level").alias("all")))  # one row
    at = F.coalesce("own", "all")
    over = [F.when(v > F.get(F.array(*map(F.lit, CUTOFFS[r])), at - 1), F.lit(r)) for r, v in rule_values().items()]
    return rows.select(*measured.columns, F.array_compact(F.array(*over)).alias("rejected_by"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    Null texts have no words and fail; a null language is its own stratum; null ids and repeated
    rows are judged like others; without labels no level is usable and the base verdict stands.
    """
    measured = settle(measure(table(spark, sf_dir, "documents")), "quality")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    judged = judge(measured, *choose_levels(measured, labels))
    failed = failed_base()
    return judged.select(F.col("id").alias("doc_id"), *MEASURES, failed.alias("base_failed"), (~failed & (F.size("rejected_by") == 0)).alias("kept"))


_VALUES = {
    "symbols": "n_symbols * 1000 // nullif(word_chars, 0)",
    "capitals": "n_capitals * 1000 // nullif(word_chars, 0)",
    "dup_lines": "n_dup_lines * 1000 // nullif(n_lines, 0)",
    "repeats": "n_repeat_words * 1000 // nullif(n_words, 0)",
    "long_words": "word_chars * 1000 // nullif(n_words, 0)",
    "digits": "n_digits * 1000 // nullif(word_chars, 0)",
}
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n >= 2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    least({", ".join("1 + " + " + ".join(f"CASE WHEN coalesce({e}, 0) <= {c} THEN 1 ELSE 0 END" for c in CUTOFFS[r]) for r, e in _VALUES.items())}) AS first FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT lang, quality, first FROM b JOIN q ON b.doc_id = q.doc_id WHERE NOT base_failed),
t AS (SELECT count(*) + 1 AS tests FROM (SELECT DISTINCT lang FROM x) s),
c AS (SELECT together, lang, level, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND first <= level) AS k,
        count(*) FILTER (quality = 0 AND first <= level) * count(*) FILTER (quality = 1) - count(*) FILTER (quality = 1 AND first <= level) * count(*) FILTER (quality = 0) AS gain
      FROM (SELECT false AS together, lang, quality, first FROM x UNION ALL SELECT true, NULL, quality, first FROM x) y, (SELECT unnest(range(1, {LEVELS + 1})) AS level) l GROUP BY together, lang, level),
u AS (SELECT together, lang, level, gain FROM c, t WHERE gain > 0 AND k < n * {RISK} AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1),
        lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) <= {LEVEL} / tests),
w2 AS (SELECT together, lang, level FROM u QUALIFY row_number() OVER (PARTITION BY together, lang ORDER BY gain DESC, level) = 1),
f AS (SELECT b.*, first <= coalesce(o.level, (SELECT level FROM w2 WHERE together), 0) AS rejected FROM b LEFT JOIN w2 o ON NOT o.together AND b.lang IS NOT DISTINCT FROM o.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""
