"""Text operators against brute force on small tables, with nulls, repeats, long texts and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import subprocess
import sys
import time
import urllib.parse
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import chat, decontaminate, lm, mixing, neardup, quality, repeats, secrets, simhash, tokens
from voxmill.llm.common import lower_words, uniform, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
public_tokenizers = pytest.importorskip("public_tokenizers")


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with near and exact copies, shared passages, nulls, empties, repeats, a long one."""
    rng = random.Random(5)
    shared = prose(rng, 80)
    out = [(k, prose(rng, rng.randrange(1, 200)), "en", f"src{k % 3}", 0) for k in range(60)]
    for k in range(60, 80):
        out.append((k, prose(rng, 30) + " " + shared + " " + prose(rng, 30), "de", "src0", 0))
    base = prose(rng, 300).split()
    for k in range(80, 100):
        w = list(base)
        w[rng.randrange(300)] = "changed"
        out.append((k, " ".join(w), "fr", "src0", 0))
    out += [(k, out[3][1], "en", "src0", 0) for k in range(100, 120)]
    out += [(120, None, None, None, None), (121, "", "", "", 0), (122, " \t\n ", "en", "src1", 4), (None, "no id at all here", "en", "src1", 0), (None, shared, "en", "src1", 0)]
    out += [(123, prose(rng, 5000, 3000), "en", "src2", 0), (124, "UPPER Case Wörter\u00a0x\u2003y", "en", "src2", 0), (125, "a", "en", "src2", 0), (126, "a b", "en", "src2", 0)]
    out += [out[5], out[5], out[60]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With more columns, named as the operators name their own."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("fp", "h", "n", "chunk", "content", "__text", "digest", "size", "draw", "key", "ratio", "label", "hold", "good", "bad", "first", "copy", "component_id", "__row", "__rank", "n_tokens", "epoch", "part", "shared", "passages")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ 10: SimHash


def brute_components(rows):
    prints = [simhash.fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] > label[j]:
                    label[i], moved = label[j], True
    smallest = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            smallest[x] = min(smallest.get(x, r[0]), r[0])
    return Counter((r[0], f"{p:016x}", smallest.get(x)) for r, p, x in zip(rows, prints, label))


def test_simhash_components(docs, rows, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "DIRECT", 4)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == brute_components(rows)


def test_fingerprint_by_hand():
    import xxhash

    text = "The cat SAT on the mat the cat sat"
    tokens = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[k : k + 3]), 42) for k in range(len(tokens) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint("") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([c ^ np.array([0, *(1 << rng.integers(0, 63, 5))]).astype(np.uint64) for c in centres]))
    tree = simhash.VantageTree(points[:100], 4)
    home, (which, leaf) = tree.home(points), tree.visits(points, 3)
    seen = set(zip(which.tolist(), leaf.tolist()))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 3):
            assert (i, home[j]) in seen


def test_empty_tables(spark, none):
    assert simhash.simhash_components(none).count() == 0
    assert neardup.keep_first(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert lm.interpolated_scores(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert mixing.mix(none, mixing.LEVELS, {}).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(none, labels).count() == 0 and quality.keep_drawn(none, labels).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.drop_leaks(none, items).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_messages(chat.event_log(turns))).count() == 0


def shingle_set(text):
    t = lower_words(text)
    return {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set()


def test_near_duplicates(docs, rows):
    got = {}
    for r in neardup.groups(docs).collect():
        got[r.doc_id] = r.group_id
    known = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    for a, x in known.items():
        for b, y in known.items():
            s = len(x & y) / len(x | y) if x | y else 1.0
            if s >= 0.8:
                assert got[a] == got[b], (a, b, s)
            elif s < 0.1:
                assert got[a] != got[b], (a, b, s)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert set(ids) - {None} == set(got.values()) and ids[None] == 2 and max(ids[k] for k in ids if k is not None) == 1


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_on_both_sides_of_the_bound(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng, texts, near = random.Random(6), [], {}
    for k in range(240):  # a block edited, or text appended; similarities of 0.70 to 0.87
        base = prose(rng, 304, 5000).split()
        n = rng.randrange(45, 90)
        copy = base + prose(rng, n, 5000).split() if k % 2 else base[:50] + prose(rng, n // 2, 5000).split() + base[50 + n // 2 :]
        texts += [" ".join(base), " ".join(copy)]
        a, b = map(shingle_set, texts[-2:])
        near[k] = len(a & b) / len(a | b)
    chain = prose(rng, 304, 5000).split()  # one large cluster
    texts += [" ".join(chain[:10 * k] + prose(rng, 2, 5000).split() + chain[10 * k :]) for k in range(30)]
    got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)).collect()}
    bits = {k: (simhash.fingerprint(texts[2 * k]) ^ simhash.fingerprint(texts[2 * k + 1])).bit_count() for k in near}
    want = {k: s >= 0.8 or bits[k] <= 3 for k, s in near.items()}
    assert {k: got[2 * k] == got[2 * k + 1] for k in near} == want and 60 < sum(want.values()) < 180
    assert {got[k] for k in range(480, 510)} == {480}


@pytest.mark.parametrize("block", [4096, 16])
def test_large_groups_of_near_duplicates(spark, monkeypatch, block):
    """One key holds a large family, small ones at all distances from each other and strangers; another key is one family."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng, sketches = np.random.default_rng(8), []
    family = lambda base, n, edits: [np.where(rng.random(256) < edits, rng.integers(1, 256, 256), base) for _ in range(n)]
    bases = rng.integers(1, 256, (5, 256))
    sketches += family(bases[0], 150, 0.08) + family(bases[1], 40, 0.1) + family(bases[2], 30, 0.17) + family(bases[0], 40, 0.25) + list(rng.integers(1, 256, (20, 256)))
    sketches += family(bases[3], 120, 0.05) + family(bases[4], 5, 0.1)
    sketches = np.array(sketches, np.uint8)
    key = np.repeat([0, 1, 2], [280, 120, 5])
    fps = rng.permutation(10**12 + np.arange(405)) * np.where(rng.random(405) < 0.5, -1, 1)
    nodes = spark.createDataFrame([(int(f), int(k), bytearray(x)) for f, k, x in zip(fps, key, sketches)], "fp long, key long, value binary")
    asked = []

    def fetch(placed):
        asked.append(placed.count())
        return placed.join(nodes.select("fp", "value"), "fp")

    rows = nodes.select("fp", "key")
    got = neardup.compared(rows, rows.groupBy("key").agg(F.count("*").alias("n")), 405, fetch, neardup.by_sketch)
    label = {r.node: r.label for r in simhash.components(got).collect()}
    want = simhash.Links(405)
    for k in range(405):
        with_k = np.flatnonzero(key == key[k])
        near = with_k[neardup.alike(sketches[with_k], sketches[[k]]) >= neardup.LOOSE]
        want.add(np.full(len(near), k), near)
    assert len(set(want.parent)) > 10
    named = {}
    for k, f in enumerate(fps.tolist()):
        named.setdefault(want.parent[k], set()).add(f)
    assert {frozenset(x) for x in named.values() if len(x) > 1} == {frozenset(f for f in label if label[f] == v) for v in set(label.values())}
    assert asked == ([405] if block == 4096 else [405, 280])  # the key that is one family is not met again


# ------------------------------------------------------------------ 7: substrings


def test_repeats(docs, rows):
    first = {}
    for r in rows:
        w = words(r[1])
        if r[0] is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, r[0]), r[0])
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[k : k + 50])] < r[0]:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == want and any(k[2] for k in want)


def test_sliding_min():
    rng = np.random.default_rng(2)
    for n in (1, 5, 43, 44, 200):
        x = rng.integers(0, 1 << 40, n).astype(np.uint64)
        assert repeats.sliding_min(x, 43).tolist() == [x[k : k + 43].min() for k in range(max(0, n - 42))]


# ------------------------------------------------------------------ 9: tokens


def test_token_counts(spark, docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in rows)
    cache = tokens.empty_cache(spark)
    assert Counter(map(tuple, tokens.token_counts(docs, path, cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in rows})
    tokens.token_counts(docs, path, cache).count()
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again


def test_token_counter_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), tokens.TokenCounter(path, limit=50)
    rng = random.Random(3)
    alphabet = "ab  \n\t'stREé1½ñ日\u0085\u00a0\x1c.,!?<|endoftext|>"
    for text in ["", "<|endoftext|>", "x<|endoftext|> y", " don't  I'll\n\n\n z"] + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]:
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


# ------------------------------------------------------------------ 4: secrets

KEYS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in KEYS.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


SECRET = "password=hunter2secret"


def wrapped():
    url = urllib.parse.quote(SECRET, safe="")
    b64 = base64.b64encode(SECRET.encode()).decode()
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    deflated = base64.b64encode(zlib.compress(SECRET.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    entity = "".join(f"&#{ord(c)};" for c in SECRET)
    return [url, urllib.parse.quote(url, safe=""), b64, packed, deflated, escaped, entity, base64.b64encode(packed.encode()).decode(), urllib.parse.quote(base64.b64encode(escaped.encode()).decode(), safe="")]


@pytest.mark.parametrize("token", wrapped())
def test_nested_layers(token):
    text = f"é before {token} after"
    base, found, _ = secrets.scan(text)
    assert not base and len(found) == 1
    start, kind, end = found[0]
    inside = text[start:end]
    assert kind == 0 and token.startswith(inside) and len(token.rstrip("=")) - 4 <= len(inside)
    assert secrets.mask(text) == f"é before [SECRET]{token[len(inside):]} after"


@pytest.mark.parametrize("token", wrapped())
def test_every_copy_of_a_blob_has_its_span(token):
    text = f"{token} again {token} and {token}"
    alone = secrets.scan(token)[1]
    places = [m.start() for m in re.finditer(re.escape(token), text)]
    assert len(places) == 3 and secrets.scan(text)[1] == [(p + a, kind, p + b) for p in places for a, kind, b in alone]
    assert secrets.mask(text).count("[SECRET]") == 3


def test_different_blobs_of_one_text_have_their_spans():
    assert len(secrets.scan(" ".join(wrapped()))[1]) == len(wrapped())


@pytest.mark.parametrize("blob", [base64.b64encode(x).rstrip(b"=").decode() for x in (SECRET.encode(), b"\0\xff" + SECRET.encode() + b"\xe9", gzip.compress(SECRET.encode()), gzip.compress(b"first") + gzip.compress(SECRET.encode()), zlib.compress(b"pass") + zlib.compress(SECRET[4:].encode()), gzip.compress(b"x y " * 9 + SECRET.encode() + b" z" * 99)[:-12])])
@pytest.mark.parametrize("before", ["https://example.com/", "/", "id_", "key-", "a/b_c-", "x"])
@pytest.mark.parametrize("after", ["", "-tail", "/more_of/it"])
def test_blobs_joined_to_other_text(blob, before, after):
    text = f"see {before}{blob}{after} there"
    at, end = text.index(blob), text.index(blob) + len(blob)
    found = secrets.scan(text)[1]
    assert [kind for _, kind, _ in found] == [0] and at - 4 <= found[0][0] < found[0][2] <= end + len(after) + 4
    assert base64.b64encode(SECRET.encode()).decode()[:20] not in secrets.mask(text)


@pytest.mark.parametrize("filler", [b"line of text\n", b"a"])
def test_secrets_beyond_64_mb_of_inflated_data(filler):
    data = filler * ((70 << 20) // len(filler)) + b" " + SECRET.encode()
    text = "x " + base64.b64encode(gzip.compress(data)).decode() + " y"
    assert [(a, kind, b) for a, kind, b in secrets.scan(text)[1] if kind == 0] == [(2, 0, len(text) - 2)]


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_members_inside_members(depth):
    data = b"head " + SECRET.encode()
    for k in range(depth):
        data = b"some bytes \0\xff" * (k % 2) + (gzip.compress(data) if k % 3 else zlib.compress(data)) + b" more " * (k % 2)
    text = f"x {base64.b64encode(gzip.compress(data)).decode()} y"
    assert [kind for _, kind, _ in secrets.scan(text)[1]] == [0]
    lines = base64.encodebytes(gzip.compress(b"z" * 99 + SECRET.encode()) * 40)
    assert [kind for _, kind, _ in secrets.scan("x " + base64.b64encode(gzip.compress(b"x\n" + lines + b"end")).decode())[1]] == [0]
    wide = base64.b64encode((" so " * 30 + SECRET).encode("utf-16-le"))
    assert [kind for _, kind, _ in secrets.scan("x " + base64.b64encode(gzip.compress(b"a " + wide + b" b")).decode())[1]] == [0]


def test_a_small_text_that_holds_much_takes_little_memory(tmp_path):
    """78 KB of text that inflate to 60 MB without a line end; measured in a process of its own."""
    text = base64.b64encode(gzip.compress(b"a" * (60 << 20) + b" " + SECRET.encode())).decode()
    (tmp_path / "text").write_text(text)
    code = "import resource, sys, time; from voxmill.llm import secrets; t = open(sys.argv[1]).read(); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; s = time.time(); f = secrets.scan(t)[1]; print(len(f), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024, time.time() - s)"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "text")], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent.parent).stdout.split()
    assert int(out[0]) >= 1 and int(out[1]) < 400 and float(out[2]) < 15, out


def test_scan_ends_on_cycles_and_long_texts():
    assert secrets.scan("%25" * 1000)[2] == 2
    assert secrets.scan("%2525252541" + "a" * 100_000)[0] == [(10 - 1 - 0, 2, 0)][:0] + brute_base("%2525252541" + "a" * 100_000)


@pytest.mark.parametrize("chain", ["%" + "25" * 50_000 + "41", "%4" + "%3" * 50_000 + "1", "&" + "amp;" * 25_000 + "#65;", "\\u005c" + "u005c" * 20_000 + "x41", "%" * 100_000 + "41", "\\" * 100_000 + "x41"])
def test_long_chains_of_escapes_take_one_layer(chain):
    text = f"x password=abcdef{chain} "
    start = time.time()
    _, found, layers = secrets.scan(text)
    assert time.time() - start < 3 and layers <= 3
    assert (2, 0, len(text) - 1) in found or "%%" in text or "\\\\" in text


def slow_layers(text):
    """Layer by layer, each with its map: what the escapes of one pass say, then the next pass."""
    first = [(k, k + 1) for k in range(len(text))]
    while True:
        yield text, first
        out, spans, at = [], [], 0
        for m in re.finditer(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|&#([0-9]{1,7});|&(amp|quot);", text):
            new = chr(int(m[1] or m[2], 16)) if m[1] or m[2] else chr(int(m[3])) if m[3] else {"amp": "&", "quot": '"'}[m[4]]
            out += [text[at : m.start()], new]
            spans += [*first[at : m.start()], (first[m.start()][0], first[m.end() - 1][1])]
            at = m.end()
        if not at:
            return
        text, first = "".join([*out, text[at:]]), spans + first[at:]


def test_escapes_against_one_pass_at_a_time():
    rng = random.Random(8)
    ways = [lambda c: f"%{ord(c):02x}", lambda c: f"\\u{ord(c):04X}", lambda c: f"&#{ord(c)};", lambda c: {"&": "&amp;", '"': "&quot;"}.get(c, c)]
    for _ in range(150):
        text = rng.choice(["password=hunter2secret", "AKIA" + "QWERTY1234567890", 'token: "abc.def/ghi"', "0a1b2c3d" * 3])
        for _ in range(rng.randrange(1, 4)):
            text = "".join(rng.choice(ways)(c) if rng.random() < 0.4 else c for c in text)
        text = f"so {text} it & is 5% off"
        *_, (last, first) = slow_layers(text)
        want = {(min(first[k][0] for k in range(a, b)), kind, max(first[k][1] for k in range(a, b))) for a, kind, b in brute_base(last)}
        assert want and want <= set(secrets.scan(text)[1])


def test_base64_over_lines_and_two_byte_characters():
    for data in (b"lorem ipsum dolor sit amet " * 9 + SECRET.encode() + b" and more " * 9, gzip.compress(random.Random(1).randbytes(90) + SECRET.encode()), (" so " * 30 + SECRET).encode("utf-16-le"), (" so " * 30 + SECRET).encode("utf-16-be")):
        blob = base64.b64encode(data).decode()
        for gap in ("\n", "\r\n", "\n  ", "\\n"):
            lines = gap.join(blob[k : k + 64] for k in range(0, len(blob), 64))
            text = f"see:\n{lines}\nend"
            at, end = text.index(lines), text.index(lines) + len(lines)
            assert any(kind == 0 and at <= a < b <= end for a, kind, b in secrets.scan(text)[1]), (gap, data[:9])


def test_secret_scan(docs, spark, rows):
    more = [(900, f'x Token: "abcdef" PASSWORD = qwertz api-key=nothing apikey=ABCdef1 {"0a" * 12} AKIA{"Q" * 16} AKIAshort ſecret=abcdefg toKen=abcdefg', "en", "s", 0), (901, " ".join(wrapped()), "en", "s", 0)]
    df = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).union(spark.createDataFrame(more, SCHEMA))
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_secrets(df).collect())
    want = Counter()
    for r in rows + more:
        base = brute_base(r[1] or "")
        kinds = [k for _, k, _ in base]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[(r[0], *(kinds.count(k) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    redacted = secrets.redact(docs)
    assert redacted.columns == docs.columns and redacted.where("text is null").count() == 1


# ------------------------------------------------------------------ 5: language model


def test_scores(docs, rows, monkeypatch):
    got = {}
    for size in (None, 3000):
        if size:
            monkeypatch.setattr(lm, "CHUNK_BYTES", size)
            monkeypatch.setattr(lm, "RANGE_BYTES", size)
        got[size] = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.interpolated_scores(docs).collect()), key=str)
    assert got[None] == got[3000]
    fold = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5
    train = Counter(t for r in rows if fold(r) != 1 for t in [*lower_words(r[1]), b" "])
    n, v = sum(train.values()), len(train)
    want = sorted(((r[0], fold(r) == 1, len(t), sum(train[x] > 0 for x in t), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for r in rows for t in [[*lower_words(r[1]), b" "]]), key=str)
    assert sorted((x[:6] for x in got[None]), key=str) == want
    assert sum(x[6] for x in got[None]) > sum(x[5] for x in got[None])


def test_mixture_is_a_distribution():
    weights = lm.learn(__import__("pandas").DataFrame({"b": [0, 1, 1, 3], "q2": [-1, 8, -1, 4], "q1": [10, 20, -1, 9], "n": [5, 7, 2, 9]}), 0.01)
    assert np.allclose(weights.sum(1), 1) and (weights > 0).all()


# ------------------------------------------------------------------ 3: benchmark


def test_leaks_against_all_windows(docs, rows, spark):
    rng = random.Random(9)
    items = [(0, " ".join(rows[60][1].split()[35:75])), (1, rows[3][1]), (2, "a"), (3, None), (4, "..."), (5, prose(rng, 40)), (6, " ".join(rows[81][1].split()[50:90])), (7, "no id at all here")]
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = {}
    for d in {(r[0], r[1]) for r in rows}:
        w = decontaminate.plain_words(d[1])
        for item, text in items:
            t = decontaminate.plain_words(text)
            if not t:
                continue
            k = min(5, len(t))
            bag, n = Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)), len(t) - k + 1
            sh = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            best = max((sum((bag & Counter(sh[s : s + n])).values()) / (2 * n - sum((bag & Counter(sh[s : s + n])).values())) for s in range(len(sh) - n + 1)), default=0)
            if best >= 0.8:
                want[d[0], item] = best
    assert got == pytest.approx(want) and len(want) > 20
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r[0] for r in rows if not any(k[0] == r[0] and (r[0] is not None) for k in want) and not (r[0] is None and r[1].startswith("no id")) and not (r[0] is None and (None, 0) in want))


def test_leaks_in_documents_shorter_than_the_item(spark):
    rng = random.Random(4)
    item = prose(rng, 40, 4000).split()
    texts = [item[a : 40 - b] for a in range(10) for b in range(10)] + [item[1:20] + ["other"] + item[21:], prose(rng, 38).split(), item[:4], item, ["x"] + item[:39]]
    texts += [(item[:5] * 9)[:n] for n in (39, 41)] + [[]]
    items = [(0, " ".join(item)), (1, " ".join((item[:5] * 9)[:41])), (2, " ".join(item[:6])), (3, " ".join(item[:9]))]
    df = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    want = {}
    for d, t in enumerate(texts):
        sh = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        for i, text in items:
            w = text.split()
            bag = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            n = min(len(w) - 4, len(sh))
            both = max((sum((bag & Counter(sh[s : s + n])).values()) for s in range(len(sh) - n + 1)), default=0)
            if both / (len(w) - 4 + n - both) >= 0.8:
                want[d, i] = both / (len(w) - 4 + n - both), min(len(w), len(t))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert {k: r.similarity for k, r in got.items()} == pytest.approx({k: s for k, (s, _) in want.items()})
    assert all(r.n_words == want[k][1] and r.first_word + r.n_words <= len(texts[k[0]]) for k, r in got.items())
    assert sum(len(texts[d]) < 40 for d, i in want if i == 0) > 30
    assert {r.doc_id for r in decontaminate.drop_leaks(df, benchmark).collect()} == set(range(len(texts))) - {d for d, _ in want}


# ------------------------------------------------------------------ 8: chat


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 5, "assistant", "x" * 1000 + "\\<|end|>\n<|user|>\n"), (1, 2, "we|ird<|role|>", None), (1, 3, None, "é\u2028"), (2, 0, "assistant", ""), (None, 0, "user", "lost"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    log = chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.format_messages(log)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), sha(loss))


def test_fold_of_edits_and_regenerations():
    events = [(1, "start", "user", "hi"), (1, "start", "assistant", ""), (1, "delta", None, "no"), (1, "regenerate", None, None), (1, "delta", None, "ye"), (1, "delta", None, "s"), (1, "start", "user", "x"), (1, "edit", None, "y"), (2, "start", "user", "z")]
    assert list(chat.fold(iter(events))) == [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "y"), (2, 0, "user", "z")]
    with pytest.raises(ValueError):
        list(chat.fold(iter([(1, "shout", "user", "a")])))


# ------------------------------------------------------------------ 1: quality


def test_resampling_parts_good_from_bad(spark):
    rng = random.Random(11)
    good = lambda: " ".join(f"good{int(rng.random() ** 2 * 300)}" for _ in range(120))
    junk = lambda: " ".join(f"j{rng.randrange(50)}%%%" for _ in range(120))
    rows = [(k, good() + (" awfulword nastyword" if k % 10 == 7 else ""), "en", "s", 0) for k in range(1600)] + [(k, junk(), "en", "s", 0) for k in range(1600, 2000)]
    labels = [(k, int(k < 1600), int(k < 1600 and k % 10 == 7)) for k in range(0, 2000) if k % 4 != 1]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(df, lab).collect()}
    clean = [k for k in range(1600) if k % 10 != 7]
    assert sum(k in kept for k in clean) > 0.99 * len(clean)
    assert sum(k in kept for k in range(1600, 2000)) < 8 and sum(k in kept for k in range(7, 1600, 10)) < 8
    out = quality.keep_drawn(df, lab)
    assert out.columns == df.columns and {r.doc_id for r in out.select("doc_id").collect()} == kept


def test_resampling_edges(docs, rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_drawn(docs, labels).columns == docs.columns
    assert quality.resample(docs, spark.createDataFrame([], labels.schema)).count() == len(rows)  # nothing to reject by


def test_kth_largest(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 46), 1 << 46) for _ in range(500)] + [5] * 50 + [-3] * 50
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 300, 600):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


@pytest.mark.parametrize("k", [0, 1, 37, 200, 1000, None])
def test_draw_is_gumbel_top_k(spark, k):
    """The k largest sums of weight and noise, whatever the sign of the weights."""
    rng = random.Random(k or 4)
    rows = [(i, rng.gauss(0, 0.05), abs(rng.gauss(0, 0.05))) for i in range(300)]
    scores = spark.createDataFrame(rows, "doc_id long, ratio double, against double")
    model = quality.Model(None, None, None, accept=(0.01, 1.0), refuse=(0.06, 2.0))
    noise = {r.doc_id: r.g for r in scores.select("doc_id", (-F.log(-F.log(uniform(42, F.col("doc_id").cast("string"))))).alias("g")).collect()}
    weight = {i: 40 * min(a - 0.01, (0.06 - b) / 2.0) for i, a, b in rows}
    n = sum(w > 0 for w in weight.values()) if k is None else k
    want = set(sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:n])
    drawn = quality.draw(scores, model, 42, k)
    assert {r.doc_id for r in drawn.select("doc_id").collect()} == want
    if k == 37:  # the noise matters: no threshold on the weight draws the same
        assert want != set(sorted(weight, key=lambda i: -weight[i])[:n])


# ------------------------------------------------------------------ 6: mixing


def fill(total, caps, weights):
    """Pour by weight; whoever is full leaves the rest to the others."""
    given, total = [0.0] * len(caps), float(total)
    while total > 1e-9 and (free := [k for k in range(len(caps)) if weights[k] > 0 and given[k] < caps[k] - 1e-9]):
        w = sum(weights[k] for k in free)
        step = min([total / w] + [(caps[k] - given[k]) / weights[k] for k in free])
        for k in free:
            given[k] += step * weights[k]
        total -= step * w
    return given


def brute_budgets(leaves, weights, total, epochs, path=()):
    """Exact shares of the leaves below a path."""
    if path in leaves:
        return {path: total}
    below = sorted({x[: len(path) + 1] for x in leaves if x[: len(path)] == path}, key=str)
    caps = [sum(n for x, n in leaves.items() if x[: len(b)] == b) * epochs for b in below]
    out = {}
    for b, n in zip(below, fill(min(total, sum(caps)), caps, [weights.get(b, 1.0) for b in below])):
        out |= brute_budgets(leaves, weights, n, epochs, b)
    return out


def budgets(spark, leaves, weights, total, epochs):
    width = len(next(iter(leaves)))
    names = [f"l{k}" for k in range(width)]
    df = spark.createDataFrame([(*x, n) for x, n in leaves.items()], ", ".join(f"{n} string" for n in names) + ", leaf_tokens long")
    return {tuple(r[n] for n in names): r.budget for r in mixing.budgets(df, names, weights, total, epochs).collect()}


def test_budgets_give_shortages_to_siblings_first(spark):
    leaves = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 500}
    assert budgets(spark, leaves, {("a",): 1.0, ("b",): 1.0}, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    leaves = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 500}
    assert budgets(spark, leaves, {}, 200, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 170}
    assert budgets(spark, leaves, {}, 10_000, 1) == leaves and budgets(spark, leaves, {("b",): 0.0}, 200, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 0}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_against_pouring(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(3)}", rng.choice(["en", "de", None]), f"s{k}"): int(rng.paretovariate(0.6) * 50) for k in range(40)}
    weights = {("d0",): 3.0, ("d1",): 0.5, ("d0", "en"): 2.0, ("d2", "de"): 7.0, **{x: rng.choice([0.0, 1.0, 4.0]) for x in list(leaves)[:8]}}
    total = int(sum(leaves.values()) * rng.choice([0.3, 0.9, 1.5]))
    got, want = budgets(spark, leaves, weights, total, 2), brute_budgets(leaves, weights, total, 2)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) <= 3 for x in want) and all(got[x] <= 2 * leaves[x] for x in leaves)
    assert abs(sum(got.values()) - sum(want.values())) <= 1e-6 * total + 1


@pytest.mark.parametrize(("share", "epochs"), [(0.4, 1), (1.7, 3)])
def test_mix(docs, rows, share, epochs, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 5)
    out = mixing.mix(docs, {"lang": "lang", "source": "source"}, {("en",): 3.0}, share, epochs, 1, mixing.word_count("text")).collect()
    leaves = Counter()
    for r in rows:
        if len(words(r[1])):
            leaves[r[2], r[3]] += len(words(r[1]))
    given = budgets(docs.sparkSession, dict(leaves), {("en",): 3.0}, int(sum(leaves.values()) * share), epochs)
    assert sum(given.values()) == min(int(sum(leaves.values()) * share), sum(leaves.values()) * epochs)
    taken = Counter()
    for r in out:
        taken[r.lang, r.source] += r.take_tokens
        assert 0 < r.take_tokens <= r.n_tokens and r.epoch < epochs
    assert taken == Counter({k: v for k, v in given.items() if v})
    partial = Counter((r.lang, r.source) for r in out if r.take_tokens < r.n_tokens)
    assert max(partial.values(), default=0) <= 1  # one document at most is cut in each leaf
    again = mixing.mix(docs, {"lang": "lang", "source": "source"}, {("en",): 3.0}, share, epochs, 1).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


@pytest.mark.parametrize("seed", range(4))
def test_budgets_with_fractional_weights_are_exact(spark, seed):
    """Whole tokens by shares rounded down, in fractions; none is lost on the way down."""
    from fractions import Fraction

    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(4)}", f"s{k}"): rng.choice([3, 40, 999, 10**12]) for k in range(30)}
    weights = {(f"d{k}",): rng.choice([0.1, 0.3, 0.7, 1 / 3]) for k in range(4)} | {x: rng.choice([0.1, 0.2, 0.6, 0.7, 1e-6, 123456.789]) for x in list(leaves)[:20]}
    whole = {x: Fraction(round(w * mixing.UNIT)) for x, w in weights.items()}

    def share(total, below):
        """below: (cap, weight) by name; the same rule as the operator's, in fractions."""
        order = sorted(below, key=lambda n: (below[n][0] / below[n][1], n))
        full, spent = [], 0
        for k, n in enumerate(order):
            if below[n][0] * sum(below[m][1] for m in order[k:]) <= (total - spent) * below[n][1]:
                full.append(n)
            spent += below[n][0]
        rest, open_, out, upto = total - sum(below[n][0] for n in full), [n for n in order if n not in full], {n: int(below[n][0]) for n in full}, Fraction(0)
        for n in open_:
            w, all_ = below[n][1], sum(below[m][1] for m in open_)
            out[n] = int(rest * (upto + w) // all_) - int(rest * upto // all_)
            upto += w
        return out

    for part in (0.001, 0.31, 0.77):
        total = int(sum(leaves.values()) * part)
        got = budgets(spark, leaves, weights, total, 1)
        tops = sorted({x[0] for x in leaves})
        above = share(total, {d: (Fraction(sum(n for x, n in leaves.items() if x[0] == d)), whole[(d,)]) for d in tops})
        want = {}
        for d in tops:
            want |= {(d, n): v for n, v in share(above[d], {x[1]: (Fraction(n), whole.get(x, Fraction(mixing.UNIT))) for x, n in leaves.items() if x[0] == d}).items()}
        assert got == want and sum(got.values()) == total
    assert budgets(spark, {("a",): 3}, {("a",): 0.7}, 3, 1) == {("a",): 3}


def test_columns_of_any_name_come_back_as_they_were(spark):
    rng = random.Random(8)
    text = prose(rng, 60)
    rows = [(k, text if k < 3 else prose(rng, 60), "en", "src1", 0) for k in range(8)] + [(None, None, None, None, None)]
    names = ("__rank", "rank", "row", "copy", "id", "domain", "fp", "group_id", "whole")
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 7, None}
    for made in (kept, secrets.redact(docs), decontaminate.drop_leaks(docs, spark.createDataFrame([(1, "x y z")], "item_id long, text string"))):
        assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for r in made.collect() for n in names)
    assert {r.domain for r in mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, 1.0, 1).collect()} == {"domain1"}
