"""Document fingerprints: one-permutation MinHash, in DataFrame expressions only.

A text's word shingles are hashed once; the top bits of a hash choose its bin and each bin
keeps its smallest hash.  Empty bins borrow from a filled bin that they alone choose at random
(optimal densification): a fixed probe sequence per bin, then the filled bin with the smallest
pair hash.  ``BITS`` low-order bits of every bin are stored, and a likeness estimate removes
the share of bins that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, let, long_literal, table, words

BINS = 256
BITS = 8
SHINGLE = 5
#: Probes of a bin's own sequence before the exact search among the filled bins.
PROBES = 16
_PER_LONG = 64 // BITS
_SHIFT = 64 - BINS.bit_length() + 1
#: The largest value below the bin bits; marks a bin without a shingle.
_NONE = (1 << _SHIFT) - 1


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all ``width``-word shingles; of the whole sequence if it is shorter; none without words."""
    hashed = F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>"))
        .when(F.size(h) < width, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))
        .otherwise(
            F.transform(
                F.slice(h, 1, F.greatest(F.size(h) - width + 1, F.lit(1))),
                lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]),
            )
        ),
    )


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def _probe(i: Column, t: int) -> Column:
    """The t-th bin that bin i looks at: multiply-shift with an odd multiplier of its own."""
    a, b = (2654435761 * (2 * t + 3)) % (1 << 31) | 1, (40503 * 65537 * (t + 1)) % (1 << 31)
    return F.shiftright(i.cast("long") * F.lit(a).cast("long") + F.lit(b).cast("long"), 11).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int")


def bins(text: Column) -> Column:
    """The ``BINS`` bin values of a text with at least one word, in bin order, densified."""
    marks = F.array(*[long_literal((b << _SHIFT) | _NONE) for b in range(BINS)])
    none = long_literal(_NONE)
    ordered = F.sort_array(F.concat(shingle_hashes(text), marks))
    low = let(
        ordered,
        lambda s: F.transform(F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))), lambda x: x.bitwiseAND(none)),
    )

    def dense(v: Column) -> Column:
        filled = F.filter(F.transform(v, lambda x, i: F.when(x != none, i)), lambda i: i.isNotNull())

        def borrow(i: Column, f: Column) -> Column:
            probes = [F.nullif(F.get(v, _probe(i, t)), none) for t in range(PROBES)]
            nearest = F.array_min(F.transform(f, lambda j: F.struct(F.xxhash64(i, j).alias("h"), j.alias("j"))))
            return F.xxhash64(F.coalesce(*probes, F.get(v, nearest["j"])), i)  # else all borrowers of one bin would agree by chance at once

        return let(filled, lambda f: F.transform(v, lambda x, i: F.when(x != none, x).otherwise(borrow(i, f))))

    return let(low, dense)


def pack(values: Column) -> Column:
    """The low ``BITS`` bits of each bin, ``64 / BITS`` bins to a long."""
    mask = F.lit((1 << BITS) - 1).cast("long")

    def one(g: Column) -> Column:
        out = F.get(values, g * _PER_LONG).bitwiseAND(mask)
        for k in range(1, _PER_LONG):
            out = F.shiftleft(out, BITS).bitwiseOR(F.get(values, g * _PER_LONG + k).bitwiseAND(mask))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), one)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (array of longs) of a text column; an empty array without words."""
    plain = F.coalesce(text, F.lit(""))
    empty = F.translate(plain, SPACES, "") == ""
    return F.when(empty, F.array().cast("array<long>")).otherwise(let(bins(plain), pack))


def hex_digits(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1; two empty ones are alike, one is not."""
    ones = sum(1 << (BITS * k) for k in range(_PER_LONG))

    def agree(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        step = BITS // 2
        while step:
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
            step //= 2
        return (F.lit(_PER_LONG) - F.bit_count(z.bitwiseAND(long_literal(ones)))).cast("int")

    same = F.aggregate(F.zip_with(a, b, agree), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    estimate = (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.least(F.greatest(estimate, F.lit(0.0)), F.lit(1.0)))
    )


#: Bits of a block number that one window orders.
GROUP_BITS = 16


def block_successors(blocks: DataFrame, bits: int = 56) -> DataFrame:
    """(block, successor): the next smaller block; after the smallest comes the largest.

    Levels of windows: blocks inside groups of 2 ** GROUP_BITS numbers, the groups alike, and so on up
    to a few hundred, so no window sees more rows than a group has numbers, however sparse ids are.
    """
    if bits <= GROUP_BITS:  # signed numbers of so many bits
        w = Window.partitionBy(F.lit(1))
        return blocks.select("block", F.coalesce(F.lead("block").over(w.orderBy(F.col("block").desc())), F.max("block").over(w)).alias("successor"))
    grouped = blocks.select("block", F.shiftright("block", GROUP_BITS).alias("super"))
    inside = grouped.withColumn("succ", F.lead("block").over(Window.partitionBy("super").orderBy(F.col("block").desc())))
    heads = grouped.groupBy("super").agg(F.max("block").alias("head"))
    after = block_successors(heads.select(F.col("super").alias("block")), bits - GROUP_BITS).select(F.col("block").alias("super"), F.col("successor").alias("next"))
    over = after.join(heads.select(F.col("super").alias("next"), F.col("head").alias("over")), "next").select("super", "over")
    return inside.join(over, "super").select("block", F.coalesce("succ", "over").alias("successor"))


def next_rows(docs: DataFrame, key: str, text: str, derived: dict[str, Column]) -> DataFrame:
    """``docs`` (key, text) with derived columns and a struct ``next``: text and derived columns of the row that follows by descending key.

    After the last row comes the first; null keys come last and repeated keys are ordered by
    text.  A window sees one block of 256 consecutive keys; only the last row of a block looks
    further, at the first row of the following block, which a table of block heads provides.
    The texts move once: both branches read the same exchange.
    """
    block = F.shiftright(F.coalesce(F.col(key), F.lit(-(1 << 61)).cast("long")), 8)
    w = Window.partitionBy("block").orderBy(F.col(key).desc_nulls_last(), F.col(text))
    dealt = docs.select(key, text, block.alias("block")).repartition("block")
    after = F.struct(text, *derived)
    heads = dealt.withColumn("before", F.lag(F.lit(1)).over(w)).filter("before IS NULL").select(F.col("block").alias("successor"), F.col(text), *[c.alias(n) for n, c in derived.items()])
    heads = heads.select("successor", after.alias("over"))
    over = block_successors(docs.select(block.alias("block")).distinct()).join(heads, "successor").select("block", "over")
    rows = dealt.select("*", *[c.alias(n) for n, c in derived.items()]).withColumn("inside", F.lead(after).over(w))
    return rows.join(over, "block").withColumn("next", F.coalesce("inside", "over")).drop("inside", "over", "block")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text replaces the last third of the code points by as many first ones of the
    next document.  A null text counts as empty; a text without words has the fingerprint ''
    (likeness 1 to another such text, 0 to any other); an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next.text").substr(F.lit(1), third))
    rows = next_rows(docs, "doc_id", "text", {"mark": fingerprint(F.col("text"))}).select(
        "doc_id", n.cast("long").alias("n_chars"), "mark", F.col("next.mark").alias("next_mark"), edited.alias("edited")
    )
    rows = rows.select("doc_id", "n_chars", "mark", "next_mark", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_mark"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_digits(F.col("mark")).alias("fingerprint"),
        hex_digits(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
