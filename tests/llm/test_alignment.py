"""Token alignment, packing and hard negatives against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from importlib.resources import files

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import align, negatives, packing
from voxmill.llm.vocab import ByteLevel

A, B = (str(files("public_tokenizers") / name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a \n", "\n a", "x \t\t y", "don't  I'll", "<|endoftext|>", "a <|endoftext|> b<s></s>", "l▁m n", "日本語 テキスト", "é è́ ﬁ Ａ", "a   b", "\x1c \x1d q", "😀 😀😀", "z" * 3000, "ab " * 500, "0x1f,2.5e-7;{}"]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["alpha", "beta's", "12345", "naïve", "hello,", "(world)", "\n", "\t", " ", "  ", "日本", "x_y", "--", "ZZtop", "😀"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    plain, told = ByteLevel(A, plain=True, limit=50), ByteLevel(A, limit=50)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    for x in HARD + texts(300, 1):
        assert told.ids(x) == struct.pack(f"<{len(y := library.encode(x, add_special_tokens=False).ids)}I", *y)
    library.encode_special_tokens = True
    for x in HARD + texts(300, 2):
        assert plain.ids(x) == struct.pack(f"<{len(y := library.encode(x, add_special_tokens=False).ids)}I", *y)
    assert plain.fast and all(plain.fast.encode_ordinary(x) == library.encode(x, add_special_tokens=False).ids for x in (p.decode() for p in plain.pieces if p.decode("utf-8", "ignore").encode() == p))


def test_products():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 3, (rng.integers(1, 9), 7)), rng.integers(0, 3, (7, rng.integers(1, 9)))
        sparse = lambda m: align.csr(*np.nonzero(m), m[np.nonzero(m)], *m.shape)
        dense = lambda m: np.stack([np.bincount(m.indices[i:j], m.data[i:j], m.width) for i, j in zip(m.starts, m.starts[1:])])
        assert (dense(align.product(sparse(a), sparse(b))) == a @ b).all() and (dense(align.transpose(sparse(a))) == a.T).all()


def brute_align(x):
    """Offsets where tokens end, by whole texts and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters = align.ByteLevel(A, plain=True).pieces

    def one(text):
        ids = [library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)] if text else [[], []]
        parts = [[letters[i] for i in ids[0]], [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [model.id_to_piece(i)]]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return [], [], []
        ends = [list(np.cumsum([len(p) for p in side])) for side in parts]
        links = [(i, j) for i, j in ((a, b) for a, x in enumerate(ends[0]) for b in [ends[1].index(x) if x in ends[1] else -1]) if j >= 0]
        groups, a0, b0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids[0][a0 : i + 1])) + "|" + ",".join(map(str, ids[1][b0 : j + 1])))
            a0, b0 = i + 1, j + 1
        return ids, [(ids[0][i], ids[1][j]) for i, j in links], groups

    told = [one(t) for t in x]
    counts = Counter(p for _, links, _ in told for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [(len(i[0]) if i else 0, len(i[1]) if i else 0, len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, k, g in told]


@pytest.mark.parametrize("share", [align.HOT_SHARE, 0.02, 2.0])
def test_alignment(spark, monkeypatch, share):
    monkeypatch.setattr(align, "HOT_SHARE", share)
    x = [*HARD, *texts(120, 3), *texts(20, 3), None]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 5) for k, t in enumerate(x)], "doc_id long, text string, row int").repartition(5)
    got = align.align_documents(docs, A, B)
    want = sorted(zip([str(k if k % 9 else None) for k in range(len(x))], brute_align(x)))
    assert sorted((str(r.doc_id), tuple(r[1:8])) for r in got.collect()) == want
    assert align.align_documents(docs.limit(0), A, B).count() == 0


def test_overlaps(spark, monkeypatch):
    monkeypatch.setattr(align, "SPAN", 64)
    docs = spark.createDataFrame(list(enumerate(texts(20, 4) + HARD)), "doc_id long, text string")
    links = align.token_links(docs, A, B).toPandas()
    told = {r.doc_id: r for r in align.align_documents(docs, A, B).collect()}
    for doc, some in links.groupby("doc_id"):
        assert len(some) == told[doc].n_overlaps and some.ends_together.sum() == told[doc].n_links and some.group.nunique() == told[doc].n_groups
        assert some.n_bytes.sum() == len((" " + docs.where(docs.doc_id == doc).first().text).encode())
    assert set(links.doc_id) == {k for k, r in told.items() if r.n_a}


def pieces_of(x, capacity):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(A).encode(x or "", add_special_tokens=False).ids, 2]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, i, j - i, zlib.crc32(struct.pack(f"<{j - i}I", *ids[i:j]))) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]


def test_packing_of_documents(spark):
    x = [*HARD, *texts(100, 5), None, *["same text"] * 30]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1) for k, t in enumerate(x)], "doc_id long, text string, sequence_id int").repartition(3)
    got = packing.pack_documents(docs, A, 2, capacity=64, ids=False).toPandas()
    want = sorted((str(float(k)) if k % 9 else "nan", *p) for k, t in enumerate(x) for p in pieces_of(t, 64))
    assert sorted(zip(got.doc_id.astype(float).astype(str), got.piece, got.start, got.length, got.ids_crc32)) == want
    whole(got, 64)
    told = packing.pack_documents(docs, A, 2, capacity=64).collect()
    assert sorted(zlib.crc32(r.ids) for r in told) == sorted(got.ids_crc32)
    assert packing.pack_documents(docs.limit(0), A, 2).count() == 0


def whole(got, capacity):
    """Sequences have no gaps and are not too long."""
    got = got.sort_values(["sequence_id", "offset"])
    ends = (got.offset + got.length).groupby(got.sequence_id).shift(fill_value=0)
    assert (got.offset == ends).all() and ((got.offset + got.length) <= capacity).all()


@pytest.mark.parametrize("seed, low, high, groups", [(1, 1, 1024, 256), (2, 300, 700, 64), (4, 1024, 1024, 4), (5, 341, 345, 256)])
def test_packing_is_tight(spark, seed, low, high, groups):
    rng = random.Random(seed)
    lengths = [rng.randint(low, high) for _ in range(6000)]
    pieces = spark.createDataFrame([(k, 0, n, "x") for k, n in enumerate(lengths)], "row long, piece int, length long, rank string")
    got = packing.pack(pieces, groups=groups).toPandas()
    whole(got, 1024)
    assert sorted(got.length) == sorted(lengths) and (got["rank"] == "x").all()
    rooms, used = Counter(), 0  # best fit, longest first
    for n in sorted(lengths, reverse=True):
        room = min((r for r, c in rooms.items() if c and r >= n), default=None)
        used += room is None
        rooms[1024 if room is None else room] -= room is not None
        rooms[(1024 if room is None else room) - n] += 1
    assert got.sequence_id.nunique() <= used * 1.01 + 1, (got.sequence_id.nunique(), used, sum(lengths) / 1024)


def brute_negatives(rows, anchors, k=5, m=3):
    """Rows (id, label, vector) one by one."""
    kept = [(i, y, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b)))
    out = []
    for n, (i, y, v) in enumerate(kept):
        if not anchors(i):
            continue
        scored = [(-dot(v, w), j, z) for q, (j, z, w) in enumerate(kept) if q != n]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:k]:
            inside = sorted(x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:m]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block, group", [(8192, 1024), (40, 3)])
def test_negatives(spark, monkeypatch, block, group):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "FIRST", 2)
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(0.05, 0.1, 6).round(2)]) for k in range(250)]
    rows += [(k, 1, [0.1, 0.0, 0.0, 0.2, 0.0, 0.0]) for k in range(250, 330)] + rows[:3] + [rows[10]] * 4 + [(400, 2, [0.5]), (410, 2, []), (420, 1, [900.0, -9e5, 2.0, 1e9 / 1024, 0.0, 0.0])]
    rows += [(None, 1, [0.1] * 6), (500, None, [0.1] * 6), (510, 1, None), (520, 1, [0.1, None]), (530, 1, [float("nan")] * 6), (540, 1, [float("inf")] * 6)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string").repartition(4)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-900, 900, 4000)[:, None] * np.array([3, -1, 2]) + rng.integers(-9, 9, (4000, 3))
    lists, reads = negatives.Lists(vectors), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(np.size(at))
            return super().__getitem__(at)

    lists.rounded = lists.rounded.view(Counted)
    anchor = np.array([3, -1, 2])
    window, row, score = lists.best(anchor, [(-(1 << 62), 1 << 62)], 4)
    want = np.argsort(-(vectors @ anchor), kind="stable")[:4]
    assert (row == want).all() and (score == (vectors @ anchor)[want]).all() and sum(reads) < 2000
