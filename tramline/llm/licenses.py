"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-case words joined by single spaces.  One Aho-Corasick pass finds the
keywords; a rule's regex runs only where one of its keywords occurs.  The rules are the hand-written
signatures of ``license_rules`` (bodies, notices, headers, addresses, exclusions) and the names of
``FAMILIES`` in four forms.  Detections are resolved by priority: an interval of words contained in
an accepted one is suppressed; an accepted exclusion suppresses likewise and is no detection itself.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .license_rules import FORM, GAP, SIGNATURES

#: Phrases of the base contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, name as a regex over words, SPDX words, keywords that open the gate).
FAMILIES = [
    ("mit", r"(?:mit|expat) licen[sc]e", r"mit", (" mit licen", " expat licen")),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?", r"mit 0", (" mit no attribution",)),
    ("apache-1.1", r"apache (?:software )?licen[sc]e(?: version)? 1 1", r"apache 1 1", (" apache ",)),
    ("apache-2.0", r"apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?", r"apache 2 0", (" apache ",)),
    ("apache", r"apache (?:software )?licen[sc]e", r"apache", (" apache ",)),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?", (" general public ", " gpl")),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?", (" general public ", " gpl")),
    ("gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)", r"gpl", (" general public ", " gpl ")),
    ("lgpl-2.1", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)(?: version| v)? ?v?2(?: 1)?", r"lgpl 2 1(?: only| or later)?", (" lesser general ", " library general ", " lgpl")),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", (" lesser general ", " lgpl")),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", r"lgpl", (" lesser general ", " library general ", " lgpl ")),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?:(?: version| v)? ?v?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?", (" affero ", " agpl")),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e(?:(?: version)? 1 [123])?", r"gfdl 1 [123]", (" free documentation ", " gfdl ")),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[sc]e)?", r"bsd 2 clause", (" bsd ", " freebsd ")),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd)(?: licen[sc]e)?", r"bsd 3 clause", (" bsd ",)),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", r"bsd 4 clause", (" bsd ",)),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?", r"0bsd", (" zero clause", " 0bsd ")),
    ("bsd", r"bsd (?:style )?licen[sc]e", r"bsd", (" bsd ",)),
    ("isc", r"isc licen[sc]e", r"isc", (" isc licen",)),
    ("mpl-1.1", r"mozilla public licen[sc]e(?: version| v)? ?1 1", r"mpl 1 1", (" mozilla public",)),
    ("mpl-2.0", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", r"mpl 2 0", (" mozilla public", " mpl ")),
    ("mpl", r"mozilla public licen[sc]e", r"mpl", (" mozilla public",)),
    ("epl-1.0", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", r"epl 1 0", (" eclipse public",)),
    ("epl-2.0", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", r"epl 2 0", (" eclipse public", " epl ")),
    ("eupl-1.2", r"european union public licen[sc]e(?:(?: version)? 1 2)?", r"eupl 1 [12]", (" european union public", " eupl ")),
    ("cddl-1.0", r"common development and distribution licen[sc]e|cddl(?:(?: version| v)? ?v?1(?: [01])?)?", r"cddl 1 [01]", (" common development", " cddl")),
    ("cpl-1.0", r"common public licen[sc]e", r"cpl 1 0", (" common public ",)),
    ("ipl-1.0", r"ibm public licen[sc]e", r"ipl 1 0", (" ibm public ",)),
    ("artistic-2.0", r"artistic licen[sc]e(?: version)? 2(?: 0)?", r"artistic 2 0", (" artistic licen", " artistic 2")),
    ("artistic-1.0", r"artistic licen[sc]e", r"artistic 1 0", (" artistic licen", " artistic 1")),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib", (" zlib ",)),
    ("libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?", (" libpng ",)),
    ("bsl-1.0", r"boost software licen[sc]e(?:(?: version)? 1 0)?", r"bsl 1 0", (" boost software", " bsl 1")),
    ("busl-1.1", r"business source licen[sc]e(?:(?: version)? 1 1)?", r"busl 1 1", (" business source", " busl ")),
    ("sspl-1.0", r"server side public licen[sc]e", r"sspl 1 0", (" server side public", " sspl ")),
    ("python-2.0", r"python (?:software foundation )?licen[sc]e(?:(?: version)? 2)?", r"(?:python|psf) 2 0", (" python software", " python licen", " psf ")),
    ("php-3.01", r"php licen[sc]e(?: version)?(?: 3 01)?", r"php 3 01", (" php licen", " php 3")),
    ("ruby", r"ruby licen[sc]e", r"ruby", (" ruby licen", " identifier ruby")),
    ("openssl", r"openssl licen[sc]e", r"openssl", (" openssl ",)),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", (" postgresql ",)),
    ("x11", r"x11 licen[sc]e", r"x11", (" x11 ",)),
    ("ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e", r"ncsa", (" ncsa ",)),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", r"wtfpl", (" what the fuck you", " wtfpl ")),
    ("unlicense", r"the unlicense|unlicense", r"unlicense", (" unlicense ",)),
    ("cc0-1.0", r"(?:creative commons zero|cc0|cc zero)(?: licen[sc]e)?(?: 1 0)?", r"cc0 1 0", (" cc0 ", " cc zero", " commons zero")),
    ("cc-by-nc-nd-4.0", r"(?:creative commons|cc) by nc nd(?: 4 0)?", r"cc by nc nd 4 0", (" by nc nd",)),
    ("cc-by-nc-sa-4.0", r"(?:creative commons|cc) by nc sa(?: 4 0)?", r"cc by nc sa 4 0", (" by nc sa",)),
    ("cc-by-nc-4.0", r"(?:creative commons|cc) by nc(?: 4 0)?", r"cc by nc 4 0", (" by nc ",)),
    ("cc-by-sa-3.0", r"(?:creative commons|cc) by sa 3 0", r"cc by sa 3 0", (" by sa 3",)),
    ("cc-by-sa-4.0", r"(?:creative commons|cc) by sa(?: 4 0)?", r"cc by sa 4 0", (" by sa ",)),
    ("cc-by-nd-4.0", r"(?:creative commons|cc) by nd(?: 4 0)?", r"cc by nd 4 0", (" by nd ",)),
    ("cc-by-3.0", r"(?:creative commons attribution|creative commons by|cc by) 3 0", r"cc by 3 0", (" cc by 3", " commons by 3", " attribution 3")),
    ("cc-by-4.0", r"(?:creative commons attribution|creative commons by|cc by)(?: 4 0)?", r"cc by 4 0", (" cc by ", " commons by ", " commons attribution")),
    ("odbl-1.0", r"open database licen[sc]e", r"odbl 1 0", (" open database", " odbl ")),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?:(?: version)? 1 1)?", r"ofl 1 1", (" open font", " ofl ")),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl", (" microsoft public", " ms pl ")),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl", (" microsoft reciprocal", " ms rl ")),
    ("public-domain", r"public domain(?: dedication)?", r"pd", (" public domain",)),
    ("proprietary", r"all rights reserved|proprietary and confidential", r"licenseref proprietary", (" all rights reserved", " proprietary ")),
]
#: (form, regex around a name, priority, confidence); the first form takes the SPDX words.
FORMS = [
    ("identifier", r"spdx license identifier {}", 100, 1.0),
    ("grant", r"(?:licensed|released|distributed|published|provided|(?:made )?available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}", 80, 0.95),
    ("reference", r"(?:see|subject to|governed by|accordance with|copy of|under) (?:the )?{}", 60, 0.85),
    ("name", r"{}", 40, 0.7),
]


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    priority: int
    confidence: float
    pattern: re.Pattern


def _as_scanned(text: str) -> str:
    """Text as the scanner has it: one character per byte of UTF-8."""
    return text.encode("utf-8").decode("latin-1")


def rules(families=FAMILIES, forms=FORMS, signatures=SIGNATURES) -> list[tuple[Rule, tuple[str, ...]]]:
    """All signature rules in order, each with its keywords."""
    out = []
    for label, form, written, keyword in signatures:
        priority, confidence = FORM[form]
        pattern = re.compile(" (" + _as_scanned(written.replace(" _", " " + GAP)) + ")(?= )")
        out.append((Rule(label, form, priority, confidence, pattern), (_as_scanned(keyword),)))
    for label, name, spdx, keywords in families:
        for form, around, priority, confidence in forms:
            first = form == "identifier"
            pattern = re.compile(" (" + around.format(f"(?:{spdx if first else name})") + ")(?= )")
            out.append((Rule(label, form, priority, confidence, pattern), (" spdx license identifier ",) if first else keywords))
    return out


#: Bytes that stand in words (0-9, a-z, all of non-ASCII), A-Z lower-cased; all others separate.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Scanner:
    def __init__(self, ruleset=None):
        self.rules = rules() if ruleset is None else ruleset
        self.gate = ahocorasick.Automaton()
        opened: dict[str, set[int]] = {}
        for i, (_, keywords) in enumerate(self.rules):
            for k in keywords:
                opened.setdefault(k, set()).add(i)
        for k, which in opened.items():
            self.gate.add_word(k, tuple(sorted(which)))
        for phrase in BASE:
            self.gate.add_word(f" {phrase} ", ()) if f" {phrase} " not in self.gate else None
        self.gate.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(words, base places as (start, label), resolved detections as (label, form, start, end, confidence))."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        if not words:
            return 0, [], []
        line = " " + b" ".join(words).decode("latin-1") + " "
        opened: set[int] = set()
        hit = False
        for _, which in self.gate.iter(line):
            hit = True
            opened.update(which)
        if not hit:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)  # word k begins behind blank k
        word = lambda at: int(np.searchsorted(blanks, at))
        base = []
        for phrase, label in BASE.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                base.append((word(at), label))
                at = line.find(f" {phrase} ", at + 1)
        found = []
        for i in sorted(opened):
            rule = self.rules[i][0]
            for m in rule.pattern.finditer(line):
                start = word(m.start())
                found.append((rule.label, rule.form, start, start + m[1].count(" ") + 1, rule.confidence, rule.priority))
        return len(words), sorted(base), resolve(found)


def resolve(found: Iterable[tuple]) -> list[tuple]:
    """Take detections by priority, then length, then place; drop those inside an accepted interval.

    The accepted intervals that lie in no other are kept in order, with rising starts and ends, so
    one look at the last that starts no later tells whether any contains a detection.
    """
    kept: list[tuple] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d[5], d[2] - d[3], d[2], d[0])):
        k = bisect_right(starts, d[2]) - 1
        if k >= 0 and ends[k] >= d[3]:
            continue
        kept.append(d)
        lo, hi = bisect_left(starts, d[2]), bisect_right(ends, d[3])
        starts[lo:hi], ends[lo:hi] = [d[2]], [d[3]]
    return sorted(((d[0], d[1], d[2], d[3], d[4]) for d in kept if d[1] != "exclusion"), key=lambda d: (d[2], d[3], d[0]))


def score(detections: Iterable[tuple], n_base: int = 0) -> float:
    """How surely a text names a license: 1 less the product of the doubts of all detections.

    A detection's doubt is that of its rule, the less the more words it covers; a base place
    counts like a detected name of three words.
    """
    doubt = 1.0
    for _, _, start, stop, confidence in detections:
        doubt *= (1.0 - confidence) * math.exp(-(stop - start) / 20.0)
    if n_base:
        doubt = min(doubt, 0.3 * math.exp(-0.15))
    return 1.0 - doubt


SCAN = "id long, n_words long, base array<struct<start:long,label:string>>, detections array<struct<label:string,form:string,start:long,stop:long,confidence:double>>, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places and resolved detections in word positions.

    A null or wordless text has no words and no detections; null ids, repeated rows and empty
    tables pass through.  No shuffle: each text is scanned where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        base_t = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        det_t = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("confidence", pa.float64())]))
        for b in batches:
            rows = [scanner.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": s, "label": x} for s, x in r[1]] for r in rows], base_t),
                    pa.array([[dict(zip(("label", "form", "start", "stop", "confidence"), d, strict=True)) for d in r[2]] for r in rows], det_t),
                    pa.array([score(r[2], len(r[1])) for r in rows], pa.float64()),
                ],
                ["id", "n_words", "base", "detections", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCAN)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every whole text; see ``scan_licenses`` for the edge cases."""
    s = scan_licenses(table(spark, sf_dir, "documents"))
    starts, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    labels = F.transform("detections", lambda x: x["label"])
    return s.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, labels)).alias("labels"),
        "score",
    )
