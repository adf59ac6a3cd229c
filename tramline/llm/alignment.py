"""Alignment of two tokenizers over a corpus: minimal groups, links, and how many documents link two ids.

Tokens of both sides are the nodes of a bipartite graph, with an edge where byte ranges overlap; union-find
over it gives the components, which are the minimal groups of tokens that end together.  Components expand
to links.  Both tokenizers cut where a chunk begins (see ``chunks``), so groups lie within chunks and each
distinct chunk is aligned once per batch; longer-lived chunks are remembered by the worker.

Counting is by blocks, the documents of one batch: a block sends each id pair once, whatever the documents
that hold it, so no pair, however frequent, has more rows than there are blocks; the counts return to the
blocks by the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ByteCodes, gather, split
from .common import fresh, settle, table, tidy

#: Distinct chunks a worker remembers, and their longest; links of a group that are written out one by one.
REMEMBERED, SHORT, ONE_BY_ONE = 150_000, 48, 4096


class Aligned(NamedTuple):
    """Chunks in order: tokens of both sides, groups, kinds of links; links (first id * size + second id) and how often each occurs (None: once), one chunk's after the other's; the groups' texts, each with its end."""

    good: np.ndarray
    a: np.ndarray
    b: np.ndarray
    groups: np.ndarray
    kinds: np.ndarray
    links: np.ndarray
    times: np.ndarray | None
    texts: list[bytes]


class PieceCodes:
    """Ids of chunks, which begin with a space, by a sentence-piece model; the model adds that space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = [self.model.piece_to_id("▁")]

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, little-endian; for an empty text the model adds no space, so a lone one is given here."""
        found = [ids if c != " " else self.space for c, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [0, *accumulate(map(len, found))]
        return [raw[4 * s : 4 * e] for s, e in pairwise(ends)]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: roots are hooked to smaller ones, then paths are halved to the end."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _links(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links between all ids of two sides of a group, with how often each occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    return (x[:, None] * size + y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers below n as decimal digits and a byte for what follows, and their lengths."""
    texts = [b"%d," % i for i in range(n)]
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, n)


def _ordered(raw: list[bytes], kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, and each list's length."""
    return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(kind).itemsize


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligner:
    """Aligns chunks of two tokenizers."""

    def __init__(self, first: str, second: str):
        self.first, self.second = ByteCodes(first, special=False), PieceCodes(second)
        self.lengths = np.array([len(x) for x in self.second.bytes], np.int64)
        self.spelled = np.frombuffer(b"".join(self.second.bytes), np.uint8)
        self.size = self.second.size
        self.digits = _decimals(max(self.first.size, self.size))
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _ids(self, chunks: list[str]) -> tuple[list[bytes], list[bytes]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [c for c in chunks if c not in known]
        made = dict(zip(new, zip(self.first.encode(new), self.second.encode(new), strict=True), strict=True))
        both = [known.get(c) or made[c] for c in chunks]
        known.update((c, x) for c, x in made.items() if len(c) <= SHORT)
        return [x[0] for x in both], [x[1] for x in both]

    def align(self, chunks: list[str]) -> Aligned:
        """``good`` is false where the bytes of a side's tokens, joined, are not the chunk's; such chunks have nothing else."""
        raw_a, raw_b = self._ids(chunks)
        sizes = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        (a, n_a), (b, n_b) = _ordered(raw_a), _ordered(raw_b)
        # the first tokenizer spells every byte, so lengths tell; the second one's bytes are compared
        good = (_sums(self.first.bytes[a], n_a) == sizes) & (_sums(self.lengths[b], n_b) == sizes)
        b_good = np.repeat(good, n_b)
        same = gather(self.spelled, self.lengths, b[b_good]) == np.frombuffer("".join([c for c, g in zip(chunks, good.tolist(), strict=True) if g]).encode(), np.uint8)
        good[good] = _sums(~same, sizes[good]) == 0
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        n = len(chunks)
        end_a, end_b = np.cumsum(self.first.bytes[a]), np.cumsum(self.lengths[b])
        ends = np.union1d(end_a, end_b)  # each stretch between two of them lies in one token of either side
        root = union_find(len(a) + len(b), np.searchsorted(end_a, ends), len(a) + np.searchsorted(end_b, ends))
        first_of = np.zeros(len(a) + 1, np.int64)
        first_of[1:] = np.cumsum(root[: len(a)] == np.arange(len(a)))  # a component's smallest node is its first token of the first side
        group = first_of[root + 1] - 1 if len(a) else root
        of_a, of_b = group[: len(a)], group[len(a) :]
        groups = int(first_of[-1])
        p, q = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        from_a, from_b = np.cumsum(p) - p, np.cumsum(q) - q
        owner_a = np.repeat(np.arange(n), n_a)
        owner = owner_a[from_a]  # of each group
        large = np.flatnonzero(p * q > ONE_BY_ONE)
        each = q[of_a]
        each[np.isin(of_a, large)] = 0
        until = np.cumsum(each)
        partner = np.repeat(from_b[of_a] - until + each, each) + np.arange(until[-1] if len(a) else 0)
        links, holder, times = np.repeat(a, each) * self.size + b[partner], np.repeat(owner_a, each), None
        if len(large):
            more = [_links(a[from_a[g] : from_a[g] + p[g]], b[from_b[g] : from_b[g] + q[g]], self.size) for g in large.tolist()]
            holder = np.concatenate([holder, *(np.full(len(x), owner[g]) for g, (x, _) in zip(large, more, strict=True))])
            order = np.argsort(holder, kind="stable")
            times = np.concatenate([np.ones(len(links), np.int64), *(t for _, t in more)])[order]
            links, holder = np.concatenate([links, *(x for x, _ in more)])[order], holder[order]
        return Aligned(good, n_a, n_b, np.bincount(owner, minlength=n), np.bincount(holder, minlength=n), links, times, self._texts(a, b, of_a, of_b, p, q, owner, n))

    def _texts(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, p: np.ndarray, q: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """The groups of each chunk, as ``a1,a2|b1;``: ids in order of group and side, each with the byte behind it."""
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + (np.cumsum(q) - q)[of_a]] = a
        ids[np.arange(len(b)) + np.cumsum(p)[of_b]] = b
        digits, lengths = self.digits
        text = gather(digits, lengths, ids)
        ends = np.cumsum(lengths[ids])
        sides = np.cumsum(p + q)
        text[ends[sides - 1] - 1] = ord(";")
        text[ends[sides - q - 1] - 1] = ord("|")
        raw = text.tobytes()
        last = np.zeros(n, np.int64)
        last[owner] = ends[sides - 1] if len(ids) else 0  # the last group of a chunk stays
        return [raw[s:e] for s, e in pairwise([0, *np.maximum.accumulate(last).tolist()])]


_aligners: dict[tuple[str, str], Aligner] = {}
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, links array<long>, times array<long>, docs array<long>"
_NAMES = [x.split()[0] for x in DOCUMENT.split(", ")]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def align_documents(docs: DataFrame, id_col: str, text_col: str, first: str | None = None, second: str | None = None) -> DataFrame:
    """A row per document, with its distinct links and how often each occurs; and a row per block, whose ``docs`` says how many documents hold each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        paths = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
        if paths not in _aligners:
            _aligners[paths] = Aligner(*paths)
        aligner, made = _aligners[paths], 0
        pairs = aligner.first.size * aligner.size
        for b in batches:
            if not b.num_rows:
                continue
            block = TaskContext.get().partitionId() << 31 | made
            made += 1
            texts = b.column(1)
            spaced = pc.if_else(pc.equal(pc.binary_length(texts.fill_null("")), 0), "", pc.binary_join_element_wise(" ", texts.fill_null(""), ""))
            found, of, counts = split(spaced)
            x = aligner.align(found.to_pylist())
            until = np.cumsum(counts)
            bad = np.concatenate(([0], np.cumsum(~x.good[of])))
            good = (bad[until] == bad[until - counts]) & (counts > 0)
            of = of[np.repeat(good, counts)]
            counts = np.where(good, counts, 0)
            n_a, n_b, n_groups, kinds = (_sums(v[of], counts) for v in (x.a, x.b, x.groups, x.kinds))
            # a number for each document and link, sorted: equal ones are one kind of link
            held = gather(x.links, x.kinds, of) + np.repeat(np.arange(len(counts)), kinds) * pairs
            if x.times is None:
                held, times = np.unique(held, return_counts=True)
            else:
                order = np.argsort(held)
                held, once = held[order], gather(x.times, x.kinds, of)[order]
                new = np.flatnonzero(np.diff(held, prepend=-1))
                held, times = held[new], np.add.reduceat(once, new) if len(new) else once
            holder, links = np.divmod(held, pairs)
            hashes, at = [], 0
            for n in counts.tolist():
                hashes.append(hashlib.sha256(b"".join([x.texts[k] for k in of[at : at + n].tolist()])[:-1]).hexdigest() if n else "")
                at += n
            per_doc = np.bincount(holder, minlength=len(counts))
            n_links = _sums(times, per_doc)
            blocks = pa.array(np.full(len(counts), block))
            yield pa.RecordBatch.from_arrays([b.column(0), n_a, n_b, n_groups, n_links, pa.array(hashes, pa.string()), blocks, _lists(links, per_doc), _lists(times, per_doc), pa.nulls(len(counts), pa.list_(pa.int64()))], _NAMES)
            own, held = np.unique(links, return_counts=True)
            no = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([no, no, no, no, no, pa.nulls(1, pa.string()), blocks[:1], _lists(own, np.array([len(own)])), pa.nulls(1, pa.list_(pa.int64())), _lists(held, np.array([len(own)]))], _NAMES)

    one, two = fresh(docs, "id", "body")
    return docs.select(F.col(id_col).cast("long").alias(one), F.col(text_col).cast("string").alias(two)).mapInArrow(tidy(run), DOCUMENT)


def pair_counts(aligned: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (home, link) of all blocks (home); and per link how many documents hold it, and whether that is its first id's highest count."""
    held = aligned.filter("docs IS NOT NULL").select("block", F.explode(F.arrays_zip("links", "docs")).alias("x")).select("block", F.col("x.links").alias("link"), F.col("x.docs").alias("docs"))
    counts = settle(held.groupBy("link").agg(F.sum("docs").alias("n")), "links").withColumn("a", F.expr(f"link div {size}"))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return held.select(F.col("block").alias("home"), "link"), counts.join(best, "a").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with what the counts of its links say."""
    docs = docs.combine_chunks()
    link = pairs["link"].to_numpy()
    order = np.argsort(link)
    link, n, best = link[order], pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order]
    lists, times = docs["links"], docs["times"]
    sizes = pc.list_value_length(lists).to_numpy()
    at = np.searchsorted(link, pc.list_flatten(lists).to_numpy())
    times = pc.list_flatten(times).to_numpy()
    holder = np.repeat(np.arange(len(sizes)), sizes)
    n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(at):
        np.add.at(n_best, holder, np.where(best[at], times, 0))
        np.add.at(total, holder, n[at] * times)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs[c] for c in names), pa.array(n_best), pa.array(total), docs["groups_sha256"]], [*names, "n_best", "count_sum", "groups_sha256"])


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or that a side doesn't spell whole, have no tokens: zeros and an empty
    hash.  Null ids and repeated rows are documents of their own; an empty table gives no rows; other
    columns are not read.  A block is a batch of documents, bounded by rows and bytes, or one longer text.
    """
    import public_tokenizers

    size = PieceCodes(second or public_tokenizers.path("piece_bpe_32k.model")).size
    aligned = settle(align_documents(docs, id_col, text_col, first, second), "aligned")
    held, counts = pair_counts(aligned, size)
    pairs = held.join(counts, "link").select("home", "link", "n", "best")
    own = aligned.filter("docs IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times")
    return own.groupBy("block").cogroup(pairs.groupBy("home")).applyInArrow(_scored, RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers in every document, against the corpus-wide counts of linked ids.

    Null and empty texts, and texts that hold the word mark U+2581, have no tokens; null ids and repeated
    rows are documents of their own; an empty table gives no rows.
    """
    return align_corpus(table(spark, sf_dir, "documents"))
