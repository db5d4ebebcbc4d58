"""Fingerprints and alignments of recordings."""

from collections import Counter

import numpy as np
import pytest

from voxmill.llm import audio


def tune(seed, notes=60):
    return audio.sound(np.random.default_rng(seed).normal(0, 0.2, notes).tolist())


def test_fingerprint_is_stable_under_noise_and_volume():
    pcm = tune(1)
    noisy = (pcm * 0.7 + np.random.default_rng(2).normal(0, 100, len(pcm))).astype("<i2")
    a, b, other = (audio.fingerprint(x.tobytes(), 8000) for x in (pcm, noisy, tune(3)))
    errors = lambda x, y: np.bitwise_count((x ^ y).view(np.uint32)).mean() / 32
    assert errors(a, b) < 0.06 < 0.25 < errors(a, other)


def test_areas_against_direct_sums():
    pcm = tune(4)
    image = audio.chroma(pcm.tobytes(), 8000)
    got = audio.fingerprint(pcm.tobytes(), 8000).view(np.uint32)
    kind, x, w, y, h = audio.filters()[0]
    for t in range(0, len(got), 17):
        window = image[t : t + audio.SPAN]
        whole, a = window[x : x + w, y : y + h].sum(), window[x : x + w, y : y + h // 2].sum()
        level = int(np.digitize(np.log((1 + a) / (1 + whole - a)), audio.CUTS))
        assert got[t] >> 30 == level ^ (level >> 1)


def test_search(spark):
    rows = [(k, 8000, tune(k % 30).tobytes()) for k in range(40)] + [(40, 8000, None), (41, None, b""), (42, 8000, b"abc"), (None, 8000, tune(3).tobytes()), (5, 8000, tune(5).tobytes())]
    schema = "rec_id long, rate int, pcm binary"
    recordings = spark.createDataFrame(rows, schema)
    cut = lambda k: audio.excerpt(tune(k)).tobytes()
    queries = spark.createDataFrame([(100, 8000, cut(3)), (101, 8000, cut(7)), (102, 8000, tune(77).tobytes()), (103, 8000, b""), (None, 8000, cut(3))], schema)
    out = audio.search(recordings, queries).collect()
    assert len(out) == len(rows)
    for r in out:
        linked = r.rec_id in (3, 33, 7, 37, None)
        assert r.n_links == int(linked)
        if linked:
            assert r.best_query == (101 if r.rec_id in (7, 37) else 100) and abs(r.best_offset - (len(tune(3)) // 5 + 37) / audio.HOP) <= 1
    classes = {r.rec_id: r.class_id for r in out}
    assert classes[33] == classes[3] == classes[None] == 3 and classes[35] == 5


def test_empty(spark):
    none = spark.createDataFrame([], "rec_id long, rate int, pcm binary")
    assert audio.search(none, none).count() == 0


def brute_align(query, held):
    """The best alignment of two lists of integers (None: silent) by trying every offset."""
    first = lambda x, k: x[k] is not None and (k == 0 or x[k] != x[k - 1])
    votes = Counter(c - q for q in range(len(query)) if first(query, q) for c in range(len(held)) if first(held, c) and held[c] == query[q])
    votes = {k: n for k, n in votes.items() if n >= audio.VOTES}
    if not votes:
        return None
    offset = max(votes, key=lambda k: (votes[k], -abs(k), k))
    pairs = [(query[k - offset], held[k]) for k in range(max(offset, 0), min(len(held), len(query) + offset))]
    bits = [32 if a is None or b is None else ((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in pairs if a is not None or b is not None]
    if len(bits) < audio.OVERLAP or sum(bits) / (32 * len(bits)) > audio.ERRORS:
        return None
    return offset, votes[offset], round(sum(bits) / (32 * len(bits)), 12)


@pytest.mark.parametrize("spots", [4096, 3])
def test_alignment_against_every_offset(spark, monkeypatch, spots):
    monkeypatch.setattr(audio, "SPOTS", spots)
    rng = np.random.default_rng(5)
    tone = lambda n: [int(x) for x in np.repeat(rng.integers(-9, 9, n), rng.integers(1, 5, n))]
    held = [tone(40) for _ in range(12)] + [[None] * 50, tone(3), [7] * 60]
    for k in range(0, 12, 3):
        held[k][10:16] = [None] * 6
    queries = [h[a : a + 30] for h, a in zip(held[:8], range(0, 40, 5))] + [[None] * 20, [7] * 40, tone(30)]
    for q in queries[:6]:
        q[4] = int(rng.integers(-9, 9))
    sides = [spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"{n} long, prints array<int>") for xs, n in ((queries, "query_id"), (held, "class_id"))]
    got = {(r.query_id, r.class_id): (r.offset, r.votes, round(r.error_rate, 12)) for r in audio.align(*sides).collect()}
    want = {(q, c): x for q in range(len(queries)) for c in range(len(held)) if (x := brute_align(queries[q], held[c]))}
    assert got == want and len(want) >= 6


def test_silence_and_held_tones_are_not_met_window_by_window(spark):
    quiet, tone = np.zeros(8000 * 20, "<i2"), np.round(np.sin(np.arange(8000 * 20) * (np.pi / 16)) * 9000).astype("<i2")
    rows = [(k, 8000, np.concatenate([quiet, tone, tune(k)]).tobytes()) for k in range(30)]
    table = spark.createDataFrame(rows, "rec_id long, rate int, pcm binary")
    prints = audio.fingerprints(table).collect()[0].prints
    assert sum(x is None for x in prints) > 500 and audio.starts(audio.fingerprints(table), "rec_id", "at").groupBy("rec_id").count().agg({"count": "max"}).first()[0] < 450
    out = audio.search(table, spark.createDataFrame([(100 + k, 8000, audio.excerpt(tune(k)).tobytes()) for k in range(30)], "rec_id long, rate int, pcm binary")).collect()
    assert sum(r.best_query == 100 + r.rec_id and abs(r.best_offset - (320_000 + len(tune(0)) // 5 + 37) / audio.HOP) <= 1 for r in out) >= 29
