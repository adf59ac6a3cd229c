"""Information-theoretic sanitisation of personal data.

Protected entities are found by form: e-mail, ip, card and phone, secrets (keys, tokens,
passwords), account numbers and titled names.  Corpus co-occurrence then tells which terms reveal
them.  A term t discloses an entity c if seeing t tells almost as much as c itself: over whole
documents of the corpus, PMI(c; t) >= ALPHA * IC(c), where IC is the entity's information content.
With document frequencies that is P(c | t) >= P(c) ** (1 - ALPHA).  The rule is applied on two
levels: to single values, and to kinds, where a word that goes with secrets or numbers of many
different values tells that one stands nearby.

Such terms are marked wherever they stand, in every document, and removed when a text is
sanitised.  Entities are generalised to the most specific ancestor (host of an e-mail, block of
an address, country code of a number) that does not disclose the value by the same rule, else to
their kind.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, settle, table, tidy

KINDS = ("email", "ip", "card", "phone", "secret", "account", "name", "term")
BASE_KINDS = 4
TERM = KINDS.index("term")
MARKS = {"email": "EMAIL", "ip": "IP", "card": "CARD", "phone": "PHONE", "secret": "SECRET", "account": "ACCOUNT", "name": "NAME", "term": "REDACTED"}
#: Share of an entity's information that a term may disclose.
ALPHA = 0.9
#: Witnesses that a pair needs: different texts for a value, documents of different values for a kind.
SUPPORT, KIND_SUPPORT = 3, 5
#: Witnesses that a task keeps of a pair between two flushes: no rule asks for more, so counts up to it are exact.
WITNESSES = max(SUPPORT, KIND_SUPPORT)
#: Counts or known terms that a task holds at once.
HELD = 100_000
#: Bits of the candidate filter: a fixed size, so what is sent to the workers never grows.
FILTER_BITS = 1 << 22

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Code points of terms: ASCII letters, and letters and marks beyond without signs, punctuation and symbols.
LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x1FFF), (0x2C00, 0x2DFF), (0x3005, 0xD7FF), (0xF900, 0xFDFF), (0xFE70, 0xFEFE), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0x10FFFF))
_TERM = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LETTERS) + "]+")
#: What stands between terms, in the syntax of Arrow's patterns.
_BETWEEN = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in LETTERS) + "]+"
_NOT_DIGITS = re.compile(r"[^0-9]+")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.])[0-9]{12,19}(?![0-9A-Za-z])")
_ASSIGNED = re.compile(
    r"(?i:\b(?:api|access|private|client|auth)[_ -]?(?:key|token|secret)|\b(?:token|secret|password|passwd|pwd|bearer)\b)"
    r"[\"']?[\x20\t]{0,3}[:=]?[\x20\t]{0,3}[\"']?([A-Za-z0-9+/_.~=-]{8,}+)"
)
_ISSUED = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}+|xox[abps]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.?\x20([A-Z][^\W\d_]+(?:\x20[A-Z][^\W\d_]+)?)")
#: Bits per character from which a long run of letters and digits is taken for random.
RANDOM_BITS = 3.0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """Base entities as (start, kind, end), in that order; code points, end exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _random(run: str) -> bool:
    digits = sum(c.isdigit() for c in run)
    if digits < 3 or len(run) - digits < 3:
        return False
    return sum(n * math.log2(len(run) / n) for n in Counter(run).values()) >= RANDOM_BITS * len(run)


def protected(text: str) -> list[tuple[int, int, int]]:
    """All protected entities as (start, kind, end): the base ones, and others that overlap none before them."""
    out = entities(text)
    more: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        more += [(m.start(1), 4, m.end(1)) for m in _ASSIGNED.finditer(text) if _DIGIT.search(m[1]) and not m[1].isdigit()]
        more += [(m.start(), 4, m.end()) for m in _ISSUED.finditer(text)]
        more += [(m.start(), 4, m.end()) for m in _RANDOM.finditer(text) if _random(m[0])]
        more += [(m.start(), 5, m.end()) for m in _ACCOUNT.finditer(text)]
    more += [(m.start(1), 6, m.end(1)) for m in _TITLED.finditer(text)]
    if not more:
        return out
    # base entities of different kinds may overlap, so places are compared with the union of their intervals
    taken: list[list[int]] = []
    for s, _, e in out:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    k = reach = 0
    for s, kind, e in sorted(more):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= reach and not (k < len(taken) and taken[k][0] < e):
            out.append((s, kind, e))
            reach = e
    return sorted(out)


def _name(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end]
    return f"{KINDS[kind]}:{_NOT_DIGITS.sub('', value) if kind in (2, 3) else value.lower() if kind in (0, 1, 6) else value}"


def ancestor(name: str) -> str | None:
    """The group that a value is generalised to where the group does not disclose it."""
    kind, value = name.split(":", 1)
    if kind == "email":
        return "in:email:" + value.rsplit("@", 1)[1]
    if kind == "ip":
        return f"in:ip:{value.split('.')[0].lstrip('0') or '0'}/8"
    if kind == "phone":
        return "in:phone:+" + value[:1]
    return None


def terms(text: str, found: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Words of letters that overlap no entity, in order of place."""
    k = reach = 0
    for m in _TERM.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            reach = max(reach, found[k][2])
            k += 1
        if reach <= m.start():
            yield m


_SPAN = "struct<start:int,kind:int,stop:int>"
FOUND = f"id long, tkey long, base array<{_SPAN}>, known array<{_SPAN}>, names array<string>"
PLACED = f"id long, tkey long, term string, places array<{_SPAN}>"
_SPAN_T = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tkey"), F.col(text_col).alias("text"))


def _spans(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "kind": k, "stop": e} for s, k, e in found]


def find_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: base spans, all entities' spans, and the names of values, ancestors and kinds; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, known, names = [], [], []
            for t in b.column(2):
                text = t.as_py() or ""
                found = protected(text)
                values = {_name(text, k, s, e) for s, k, e in found}
                base.append(_spans([x for x in found if x[1] < BASE_KINDS]))
                known.append(_spans(found))
                names.append(sorted(values | {a for v in values if (a := ancestor(v))} | {f"kind:{KINDS[k]}" for _, k, _ in found}))
            spans = pa.list_(_SPAN_T)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, spans), pa.array(known, spans), pa.array(names, pa.list_(pa.string()))], ["id", "tkey", "base", "known", "names"])

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), FOUND)


def _bit(term: Column) -> Column:
    return F.crc32(F.encode(term, "UTF-8")) % FILTER_BITS


def term_filter(terms: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits with each term's bit set; at most FILTER_BITS / 32 rows reach the driver."""
    bits = terms.select(_bit(F.col("term")).alias("b"))
    rows = bits.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS int)))").alias("v")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["w"] * 4 : r["w"] * 4 + 4] = r["v"].to_bytes(4, "little")
    return bytes(out)


class Passing:
    """Membership in a ``term_filter``: true for each of its terms, and for few others."""

    def __init__(self, wanted: bytes):
        self.wanted, self.known = wanted, {}

    def __call__(self, term: str) -> bool:
        if (p := self.known.get(term)) is None:
            if len(self.known) > HELD:
                self.known.clear()
            b = zlib.crc32(term.encode("utf-8", "replace")) % FILTER_BITS
            p = self.known[term] = bool(self.wanted[b >> 3] >> (b & 7) & 1)
        return p


def _witness(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def words_of(text: str) -> set[str]:
    """Distinct lower-case terms of a whole text; parts of entities count too, here and in all frequencies."""
    return {w.lower() for w in set(_TERM.findall(text))}


def term_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, term number) of each term of a batch of texts, and the distinct terms as they are written."""
    lists = pc.split_pattern_regex(texts.fill_null(""), _BETWEEN)
    found = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return rows, found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


#: Stands for every entity in the counts of ``cooccurrences``.
ANY = "any"


def cooccurrences(docs: DataFrame, text_col: str, wanted: bytes) -> DataFrame:
    """(entity, term, n_ct, seen): documents that hold both, for the values that pass the filter, for kinds and for ``ANY``.

    ``seen`` is the number of different witnesses, exact up to ``WITNESSES`` and no lower beyond: texts for a value; for a kind
    one value per document (that of the smallest hash), so that copies of a document are one witness.  A task hands on
    at most ``WITNESSES`` of a pair at once, a row each, which are counted once however many tasks saw them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        passes = Passing(wanted)

        def out() -> pa.RecordBatch:
            of = np.fromiter((len(n) - 1 for n in counts.values()), np.int64, len(counts))
            row = pa.array(np.repeat(np.arange(len(counts)), of))
            n = np.zeros(len(row), np.int64)
            n[np.cumsum(of) - of] = np.fromiter((n[0] for n in counts.values()), np.int64, len(counts))  # once per pair
            seen = np.fromiter((w for n in counts.values() for w in n[1:]), np.int64, len(row))
            entity, term = (pa.array([key[k] for key in counts], pa.string()).take(row) for k in (0, 1))
            batch = pa.RecordBatch.from_arrays([entity, term, pa.array(n), pa.array(seen)], ["entity", "term", "n", "seen"])
            counts.clear()
            return batch

        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                found = protected(text)
                if not found:
                    continue
                about: dict[str, int] = {ANY: 0}
                for s, k, e in found:
                    name = _name(text, k, s, e)
                    if passes(name):
                        about[name] = _witness(text)
                    kind = f"kind:{KINDS[k]}"
                    witness = _witness(name)
                    about[kind] = min(about.get(kind, witness), witness)
                words = words_of(text)
                for n, witness in about.items():
                    for w in words:
                        if (c := counts.get((n, w))) is None:
                            counts[n, w] = [1, witness]
                        else:
                            c[0] += 1
                            if len(c) <= WITNESSES and witness not in c[1:]:
                                c.append(witness)
                    if len(counts) > HELD:
                        yield out()
        if counts:
            yield out()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "entity string, term string, n long, seen long")
    rows = rows.groupBy("entity", "term", "seen").agg(F.sum("n").alias("n"))
    return rows.groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("seen"))


def document_frequencies(docs: DataFrame, text_col: str, wanted: bytes) -> DataFrame:
    """(term, df) over all documents for the terms that pass the filter (a superset of those asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        passes = Passing(wanted)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return batch

        for b in batches:
            rows, at, names = term_places(b.column(0))
            low: dict[str, int] = {}  # passing terms in lower case
            number = np.array([low.setdefault(w, len(low)) if (w := n.lower()) and passes(w) else -1 for n in names], np.int64)
            of = number[at]
            pairs = np.unique(rows[of >= 0] * max(1, len(low)) + of[of >= 0])  # a term counts once per document
            n = np.bincount(pairs % max(1, len(low)), minlength=len(low))
            counts.update({w: int(n[k]) for w, k in low.items()})
            if len(counts) > HELD:
                yield out()
        if counts:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def places(docs: DataFrame, id_col: str, text_col: str, wanted: bytes) -> DataFrame:
    """(id, tkey, term, places): each place, in any document, of the terms that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Passing(wanted)
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            row, at, names = term_places(b.column(2))
            hit = np.array([bool(n) and passes(n.lower()) for n in names], bool)
            for k in np.unique(row[hit[at]]).tolist():
                i, key, t = (c[k] for c in b.columns)
                text = t.as_py()
                at: dict[str, list] = {}
                for m in terms(text, protected(text)):
                    if passes(w := m[0].lower()):
                        at.setdefault(w, []).append({"start": m.start(), "kind": TERM, "stop": m.end()})
                for w, p in at.items():
                    for column, value in zip(rows, (i.as_py(), key.as_py(), w, p), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN_T))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(rows, types, strict=True)], ["id", "tkey", "term", "places"])

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), PLACED)


def entity_counts(found: DataFrame) -> DataFrame:
    """(entity, n_c): documents per value, ancestor and kind."""
    return found.select(F.explode("names").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, alpha: float = ALPHA, support: int = SUPPORT, kind_support: int = KIND_SUPPORT) -> DataFrame:
    """(entity, term): terms that disclose a value or a kind by the PMI rule, from counts over all documents."""
    entity = settle(entity_counts(found).filter((F.col("n_c") >= support) & ~F.col("entity").startswith("in:")), "pii-entities")
    values = entity.filter(~F.col("entity").startswith("kind:")).select(F.col("entity").alias("term"))
    least = F.when(F.col("entity").startswith("kind:"), kind_support).otherwise(support)
    total = float(max(1, found.count()))
    discloses = lambda n: F.log(F.col("n_ct") / F.col(n)) >= F.lit(1.0 - alpha) * F.log(F.col("n_c") / F.lit(total))
    counts = settle(cooccurrences(docs, text_col, term_filter(values)), "pii-counts")
    # documents with any entity are some of the term's: what fails among them need not be counted in all
    some = counts.filter(F.col("entity") == ANY).select("term", F.col("n_ct").alias("n_any"))
    pairs = counts.filter((F.col("entity") != ANY) & (F.col("seen") >= least)).join(some, "term").join(entity, "entity").filter(discloses("n_any"))
    pairs = settle(pairs.select("entity", "term", "n_ct", "n_c"), "pii-pairs")
    df = document_frequencies(docs, text_col, term_filter(pairs.select("term").distinct()))
    risky = settle(pairs.join(df, "term").filter(discloses("df")).select("entity", "term"), "pii-risky")
    for done in (entity, counts, pairs):
        forget(done)
    return risky


def _found_and_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    found = settle(find_entities(docs, id_col, text_col), "pii-found")
    risky = disclosing_terms(found, docs, text_col).select("term").distinct()
    placed = places(docs, id_col, text_col, term_filter(risky)).join(risky, "term")
    added = placed.groupBy("id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("added"))
    added = added.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), "added")
    rows = found.join(added, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return found, rows.select("id", "tkey", "base", F.array_sort(F.concat("known", F.coalesce("added", none))).alias("spans"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tkey, base spans, all spans) of every document.

    A null text has no spans; a null id is kept; repeated rows are told apart by ``tkey``, a
    hash of the text; an empty table gives no rows; only the two named columns are read, so
    others may have any name.  A disclosing term is marked in documents without the entity too.
    """
    return _found_and_spans(docs, id_col, text_col)[1]


def safe_ancestors(found: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(id, tkey, safe): per document the ancestors of its values that don't disclose a value of one document.

    The same rule as for terms: 1 / n >= (1 / total) ** (1 - alpha) discloses.
    """
    total = max(1, found.count())
    counts = entity_counts(found).filter(F.col("entity").startswith("in:") & (F.col("n_c") > F.lit(total ** (1.0 - alpha))))
    held = found.select("id", "tkey", F.explode(F.array_distinct(F.filter("names", lambda x: x.startswith("in:")))).alias("entity"))
    return held.join(counts.select("entity"), "entity").groupBy("id", "tkey").agg(F.collect_set("entity").alias("safe"))


def replace_spans(text: str, spans: list[tuple[int, int, int]], safe=()) -> str:
    """``text`` with each span generalised; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            group = ancestor(_name(text, kind, start, stop))
            detail = f" {group.split(':', 2)[2]}" if group in safe else ""
            out += [text[at:start], f"[{MARKS[KINDS[kind]]}{detail}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data generalised and disclosing terms removed in the text column.

    All columns and rows stay, in whatever names: null texts stay null, rows with a null id and
    repeated rows are treated by their text, an empty table gives an empty one.
    """
    found, spans = _found_and_spans(docs, id_col, text_col)
    spans = spans.filter(F.size("spans") > 0).dropDuplicates(["id", "tkey"])
    safe = safe_ancestors(found)
    key, i, k, s, g = fresh(docs, "key", "id", "tkey", "spans", "safe")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))
    marked = spans.join(safe.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), "safe"), same, "left").select(F.col("id").alias(i), F.col("tkey").alias(k), F.col("spans").alias(s), F.col("safe").alias(g))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = keyed.join(marked, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)), "left").select(*docs.columns, s, g)
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans, safe in zip(b.column(at), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                text = t.as_py()
                if text is not None and spans.is_valid:
                    text = replace_spans(text, [(x["start"], x["kind"], x["stop"]) for x in spans.as_py()], set(safe.as_py() or ()))
                texts.append(text)
            columns = list(b.columns[:-2])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tidy(run), docs.schema)


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["stop"])), ",")


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; see ``find_personal_data`` for the edge cases."""
    rows = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count("base" if k < BASE_KINDS else "spans", k) for k in range(len(KINDS))]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
