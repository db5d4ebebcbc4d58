"""Scores of deleted interpolation against plain counters and loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from voxmill.llm import lm


def brute_scores(rows):
    """Scores of (id, text) by dictionaries of words and pairs of words."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    said = [(fold(i), [None, *(w for w in split((t or "")) if w), " "]) for i, t in rows]

    def counted(folds):
        one, two = Counter(), Counter()
        for k, tokens in said:
            if k in folds:
                one.update(tokens)
                two.update(zip(tokens, tokens[1:]))
        starts = one.pop(None, 0)
        return one, two, lambda v: starts if v is None else one[v], sum(one.values()), sum(n > 0 for n in one.values())

    level = lambda n: 0 if n == 0 else 1 + int(math.log2(n))
    one, two, context, total, kinds = counted({0, 3, 4})
    near = lambda p: -1 if p == 0 else round(-math.log2(p) * 8)
    cells = defaultdict(Counter)
    for k, tokens in said:
        if k == 2:
            for v, w in zip(tokens, tokens[1:]):
                cells[level(context(v))][near(two[v, w] / max(context(v), 1)), near(one[w] / max(total, 1))] += 1
    weights, last = {}, (0.4, 0.4, 0.2)
    for b in range(64):
        if cells[b]:
            w, all_ = [1 / 3] * 3, sum(cells[b].values())
            for _ in range(200):
                new = [0.0] * 3
                for (q2, q1), n in cells[b].items():
                    p = [x * y for x, y in zip(w, (0 if q2 < 0 else 2 ** (-q2 / 8), 0 if q1 < 0 else 2 ** (-q1 / 8), 1 / (kinds + 1)))]
                    for j in range(3):
                        new[j] += n * p[j] / sum(p) / all_
                moved, w = max(abs(x - y) for x, y in zip(w, new)), new
                if moved < 1e-9:
                    break
            w = [max(x, 1e-6) for x in w]
            last = tuple(x / sum(w) for x in w)
        weights[b] = last
    one, two, context, total, kinds = counted({0, 2, 3, 4})
    out = []
    for (i, _), (k, tokens) in zip(rows, said):
        score = 0.0
        for v, w in zip(tokens, tokens[1:]):
            a = weights[level(context(v))]
            score += math.log10(a[0] * two[v, w] / max(context(v), 1) + a[1] * one[w] / max(total, 1) + a[2] / (kinds + 1))
        out.append((str(i), k == 1, len(tokens) - 1, round(score, 5)))
    return sorted(out)


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for gap in "\t\n\v\f\r":
        low = low.replace(gap, " ")
    return low.split(" ")


@pytest.mark.parametrize("bytes_", [9 << 20, 2000])
def test_scores_are_those_of_plain_counters(spark, monkeypatch, bytes_):
    monkeypatch.setattr(lm, "CHUNK_BYTES", bytes_)
    monkeypatch.setattr(lm, "RANGE_BYTES", bytes_)
    rng = random.Random(4)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 90}"
    rows = [(k, " ".join(word() for _ in range(rng.randrange(80)))) for k in range(120)]
    rows += [(k, rows[3][1]) for k in range(200, 230)] + [(None, "w1 w2"), (None, None), (5, ""), (6, " \t x W1 É\n"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, round(r.score, 5)) for r in lm.interpolated_scores(docs).collect())
    want = brute_scores(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, want))
