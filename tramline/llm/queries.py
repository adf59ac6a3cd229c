"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .centroids import OP12_SQL, op12_clusters
from .fingerprint import op2_fingerprints
from .licenses import op3_licenses
from .mixing import OP8_SQL, op8_mixing
from .ngram_join import op7_ngram_join
from .packing import op4_packing
from .privacy import op6_privacy
from .quality import OP10_SQL, op10_quality
from .toxicity import op5_toxicity
from .warc import OP1_SQL, op1_warc
from .webtext import op9_webtext
from .window_packing import op11_windows

QUERIES = {
    "op1_warc": op1_warc,
    "op2_fingerprints": op2_fingerprints,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_privacy": op6_privacy,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_webtext": op9_webtext,
    "op10_quality": op10_quality,
    "op11_windows": op11_windows,
    "op12_clusters": op12_clusters,
    "op13_alignment": op13_alignment,
}
#: Where SQL can express the whole query; the others are tested against brute force in tests/llm.
ORACLE = {"op1_warc": OP1_SQL, "op8_mixing": OP8_SQL, "op10_quality": OP10_SQL, "op12_clusters": OP12_SQL}
