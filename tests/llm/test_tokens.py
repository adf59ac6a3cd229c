"""Online packing, centroid clustering and alignment of tokenizers against brute force, through their registered queries."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline.llm import alignment, centroids, chunks, queries, window_packing

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "a  b", " lead", "tail ", "  ", " ", "\n", "x  y", "x   y", "x　 y", "x   y", "x  y", "x\u0085  y", "it's o'clock, isn't it?!", "café, été - naïve.",
    "a\x00b c", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>  <|endoftext|>", "w▁v", "中文 文字", "\U0001f600 \U0001f600\U0001f600", "1,234.5 6-7", "tabs\t\tand\r\nlines \n x", "\x1c \x1d  y", "é o",
    "zz" * 4000, "word " * 9000, "!?" * 700 + " " * 600 + "end",
]


def rows_of_texts():
    rnd = random.Random(3)
    vocab = ["token", "alpha,", "beta.", "über", "x1", "the", "(of)", "Zug-", "Жук", "q" * 40]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 5, 60, 900, 2500)))) for _ in range(60)]
    return [(3 * i, t) for i, t in enumerate(texts + ODD)] + [(1, None), (2, ""), (None, texts[0]), (4, texts[1]), (4, texts[1])]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = rows_of_texts()
    spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, id string, body string, n_chars long").repartition(19).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def byte_tokenizer(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = not special
    return t


@pytest.mark.parametrize("parts", [False, True])
def test_chunks_encode_like_whole_texts(parts):
    rnd = random.Random(8)
    pieces = ["a", "B", "é", "×", " ", "  ", " ", "　", " ", "\n", "\t", "'s", "'", ",", "1", "中", "\U0001f600", "\x1e", "<|endoftext|>", "|>", "ll", "'ll"]
    texts = ODD + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14))) for _ in range(4000)] + [None, ""]
    codes, plain = chunks.ByteCodes(public_tokenizers.path("byte_bpe_50k.json")), byte_tokenizer(True)
    found, of, counts = chunks.split(pa.array(["skip", *texts])[1:], parts, codes.special)
    encoded = [np.frombuffer(x, "<u4").tolist() for x in codes.encode(found.to_pylist())]
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert [i for k in of[at : at + n] for i in encoded[k]] == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += n


def test_op11_windows(spark, corpus):
    path, rows = corpus
    got = queries.QUERIES["op11_windows"](spark, path).collect()
    plain = byte_tokenizer(True)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, copies in ids.items():
        own = copies[0]  # repeated rows are equal here
        assert sum(r["length"] for r in by_doc[i]) == len(own) * len(copies)
        covered = np.zeros(len(own), int)
        for r in by_doc[i]:
            cut = own[r["start"] : r["start"] + r["length"]]
            assert len(cut) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(cut) and r["doc_tokens"] == len(own)
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == len(copies)).all()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    short = collections.Counter()
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces[:-1]]).tolist()
        short[sum(n for _, n in pieces)] += 1
    assert all(n <= 1024 and n & (n - 1) == 0 for n in short)  # nothing is padded
    assert max(v for n, v in short.items() if n < 1024) == 1 and len(sequences) - short[1024] <= 10


def test_windows_keep_their_bound_and_fit_best():
    rnd = random.Random(1)
    space = window_packing.Windows(100, 4)
    for k in range(500):
        n = rnd.randint(1, 130)
        rooms = [r for r, _ in space.rooms]
        fits = [r for r in rooms if r >= n]
        space.place([(k, 0, np.arange(n, dtype="<u4"), n)])
        assert len(space.rooms) <= 4 and all(sum(len(p[2]) for p in w) < 100 for w in space.open.values())
        if n < 100 and fits:
            left = collections.Counter(r for r, _ in space.rooms)
            expected = collections.Counter(rooms)
            expected[min(fits)] -= 1
            expected[min(fits) - n] += 1
            assert left == +collections.Counter({r: c for r, c in expected.items() if r})
    assert all(sum(len(p[2]) for p in s) == 100 for s in space.leave())
    rest = [sum(len(p[2]) for p in s) for s in space.close()]
    assert all(n == 100 or n & (n - 1) == 0 for n in rest)


def test_packing_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert window_packing.pack_online(none).collect() == [] and alignment.align_corpus(none).collect() == []


def brute_alignment(rows):
    import sentencepiece

    plain, model = byte_tokenizer(False), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spare = 256
    for c in range(256):
        if c not in chars.values():
            chars[chr(spare)] = c
            spare += 1
    out, counts = [], collections.Counter()
    for doc, text in rows:
        text = text or ""
        a, pieces = plain.encode(" " + text, add_special_tokens=False), model.encode(text, out_type=str)
        b = model.encode(text)
        bytes_a = [bytes(chars[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(pieces, b, strict=True)]
        raw = (" " + text).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((doc, 0, 0, [], None))
            continue
        groups, i, j, ends, ids = [([], [])], 0, 0, [0, 0], a.ids
        while i < len(ids) or j < len(b):
            if ends[0] <= ends[1] and i < len(ids) and not (ends[0] == ends[1] and len(groups[-1][0]) > len(groups[-1][1]) == 0):
                groups[-1][0].append(ids[i])
                ends[0] += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(b[j])
                ends[1] += len(bytes_b[j])
                j += 1
            if ends[0] == ends[1]:
                groups.append(([], []))
        groups.pop()
        links = [(x, y) for g, h in groups for x in g for y in h]
        counts.update(set(links))
        out.append((doc, len(ids), len(b), groups, links))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for doc, n_a, n_b, groups, links in out:
        if links is None:
            yield (doc, 0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (doc, n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest())


def test_op13_alignment(spark, corpus, monkeypatch):
    path, rows = corpus
    got = collections.Counter(tuple(r) for r in queries.QUERIES["op13_alignment"](spark, path).collect())
    assert got == collections.Counter(brute_alignment(rows))


def test_large_groups_multiply_counts(monkeypatch):
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" " + t for t in ODD if t and "▁" not in t] + [" café-" + "été" * 50]

    def summed():
        x = aligner.align(texts)
        total = collections.Counter()
        for owner, k, n in zip(np.repeat(np.arange(len(texts)), x.kinds).tolist(), x.links.tolist(), x.times.tolist() if x.times is not None else [1] * len(x.links), strict=True):
            total[owner, k] += n
        return total, x.texts

    one = summed()
    monkeypatch.setattr(alignment, "ONE_BY_ONE", 0)
    assert summed() == one


def test_union_find():
    rnd = random.Random(4)
    for _ in range(50):
        n = rnd.randint(1, 40)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 40))]
        label = list(range(n))
        for _ in range(n):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        u, v = (np.array([e[k] for e in edges], int) for k in range(2))
        assert alignment.union_find(n, u, v).tolist() == label


def brute_clusters(rows, k=16, rounds=3):
    keep = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [v for _, v in start]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in keep]
        for c in range(len(means)):
            members = [v for (_, v), o in zip(keep, own, strict=True) if o == c]
            if members:
                means[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in keep]
    per = collections.Counter()
    for _, d, c in found:
        per[c] += d
    return collections.Counter((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in found)


def vectors(n, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (6, 64))
    rows = [(int(i), (centres[i % 6] * (i % 7 > 0) + rnd.normal(0, 0.05 + (i % 3) / 4, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(rows[0][0], rows[0][1]), (n + 1, None), (n + 2, []), (n + 3, [0.5] * 63), (n + 4, [0.5] * 65), (n + 5, [None] + [0.0] * 63), (n + 6, [float("nan")] + [0.0] * 63), (n + 7, [float("-inf")] + [0.0] * 63), (None, [0.25] * 64), (None, [0.25] * 64)]
    return rows + [(n + 10 + i, [0.125] * 64) for i in range(90)]


@pytest.mark.parametrize("n", [4, 700])
def test_op12_clusters(spark, tmp_path, monkeypatch, n):
    rows = vectors(n, n)
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.Counter(tuple(r) for r in queries.QUERIES["op12_clusters"](spark, str(tmp_path)).collect())
    assert got == brute_clusters(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == collections.Counter(duckdb.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({centroids.OP12_SQL})").fetchall())


def test_filtering_is_exact_and_filters():
    rnd = np.random.default_rng(2)
    for kind in range(30):
        size = int(rnd.integers(1, 9))
        points = rnd.integers(-6, 7, (int(rnd.integers(1, 400)), size)) * (1 << int(rnd.integers(0, 25)))
        means = rnd.integers(-6, 7, (int(rnd.integers(1, 9)), size)) * (1 << int(rnd.integers(0, 25)))
        order, *nodes = centroids.Tree.order(points, 4)
        tree = centroids.Tree(points[order], *nodes)
        own, counts, sums = centroids.assign(tree, means)
        far = ((tree.points[:, None] - means[None]) ** 2).sum(2)
        assert (own == far.argmin(1)).all()
        assert (counts == np.bincount(own, minlength=len(means))).all()
        assert all((sums[z] == tree.points[own == z].sum(0)).all() for z in range(len(means)))


def test_whole_nodes_are_assigned(monkeypatch):
    rnd = np.random.default_rng(5)
    points = (np.repeat(rnd.integers(-500, 500, (4, 8)), 500, 0) * 10 + rnd.integers(-40, 40, (2000, 8)))
    order, *nodes = centroids.Tree.order(points)
    seen = []
    squares = centroids._squares
    monkeypatch.setattr(centroids, "_squares", lambda p, c: seen.append(len(p)) or squares(p, c))
    centroids.assign(centroids.Tree(points[order], *nodes), points[[0, 500, 1000, 1500]])
    assert sum(seen) < 100  # nodes, not points


def test_vectors_beyond_exact_arithmetic_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>").select("vec_id", "embedding", F.lit(1).alias("v"))
    with pytest.raises(Exception):  # Spark wraps the task's ValueError
        centroids.cluster(centroids.kept(df, "vec_id", "embedding")).collect()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(centroids.kept(none, "vec_id", "embedding")).collect() == []
