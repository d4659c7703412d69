import math
import random
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
from pricestrata.llm import pseudo_likelihood as pl
from pyspark.sql import functions as F


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pl, "WORDS", 60)
    monkeypatch.setattr(pl, "EVERY", 2)
    monkeypatch.setattr(pl, "BATCH", 64)


def documents(spark):
    r = random.Random(3)
    words = [a + b for a in ("ba", "co", "du", "fi", "go") for b in ("la", "me", "ni", "po", "ru", "sa", "te", "vi")]
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.9 else f"rare{r.randint(0, 300)}" for _ in range(r.randint(1, 120))), "en", "a") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(8)]
    return fx.documents(spark, [*rows, (200, None, "en", "a"), (201, " \n", "en", "a"), (202, "one", None, None), (None, "ba co", "en", "a"), rows[0]])


def brute(rows, flat):
    """Scores by loops over tokens, given the network's parameters."""
    net = pl.Network(flat)
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    by = Counter(counts.values())
    least = min((n for n in by if sum(m for k, m in by.items() if k >= n) <= pl.WORDS), default=1 << 62)
    top = sorted((w for w in counts if counts[w] >= least), key=lambda w: (-counts[w], w))
    known = {w: i for i, w in enumerate(top)}
    cls = lambda w: known[w] + 1 if known.get(w, pl.TOP) < pl.TOP else pl.ending_class(w)
    mass = Counter()
    for w, n in counts.items():
        mass[cls(w)] += n
    vocabulary = pl.Vocabulary((w, i << 8 | cls(w)) for w, i in known.items())
    tokens, seen, around = [], Counter(), Counter()
    for _, t in rows:
        words = (t or "").lower().split()
        held = {}
        if words:
            at, context = pl.windows(np.array([vocabulary[w] for w in words], dtype=np.int64))
            held = dict(zip(at.tolist(), context.tolist()))
        tokens.append((words, held))
        for i, c in held.items():
            seen[c, words[i]] += 1
            around[c] += 1
    out = []
    for (d, _), (words, held) in zip(rows, tokens):
        x = [0, 0, *(cls(w) for w in words), 0, 0]
        total, met = 0.0, 0
        for i, w in enumerate(words):
            h = np.tanh(sum(net.sides[k][x[i + 2 + o]].astype(float) for k, o in enumerate((-2, -1, 1, 2))))
            z = h @ net.out.astype(float) + net.bias
            p = math.exp(z[cls(w)] - math.log(np.exp(z).sum())) * counts[w] / mass[cls(w)]
            if i in held and around[held[i]] > 1:
                p = (seen[held[i], w] - 1 + p) / around[held[i]]
                met += 1
            total += math.log(p)
        out.append((d, len(words), total, total / len(words) if words else None, len(held), met / len(held) if held else None))
    return out


def near(a, b):
    return all(x == y if x is None or y is None or isinstance(x, int) else math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-4) for x, y in zip(a, b))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_scores_equal_brute_force(spark, small):
    docs = documents(spark)
    top, rest, mass = pl.classed(pl.word_counts(docs))
    assert 0 < len(top) <= pl.WORDS and rest.count() > 20
    flat = pl.trained(pl.coded(docs, top, mass).cache(), mass, 512)
    got = ordered(map(tuple, pl.scored(docs, 512).collect()))
    want = ordered(brute([(r["doc_id"], r["text"]) for r in docs.collect()], flat))
    assert len(got) == len(want) and all(near(g, w) for g, w in zip(got, want))
    repeated = [g[5] for g in got if g[0] is not None and (g[0] < 8 or 100 <= g[0] < 108) and g[4]]
    others = [g[5] for g in got if g[0] is not None and 8 <= g[0] < 60 and g[4]]
    assert min(repeated) == 1 and np.mean(others) < 0.5


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = documents(spark)
    a, b = (ordered(map(tuple, pl.scored(docs.repartition(n, F.col("source"), F.rand(n)), 512).collect())) for n in (2, 7))
    assert all(x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b))


def test_gradient_equals_slopes():
    """A step divided by its rate and scale is the slope of the mean log loss over real tokens, separators left out."""
    r = np.random.default_rng(1)
    x, _ = pl.line_of([bytes(r.integers(1, pl.CLASSES, n).tolist()) for n in (30, 1, 50)])
    start = r.normal(0, 0.3, pl.Network.start(np.ones(pl.CLASSES)).flat.size)

    def loss(flat):
        net = pl.Network(flat)
        net.sides, net.out, net.bias = (a.astype(np.float64) for a in (net.sides, net.out, net.bias))
        return -net.log_probabilities(x)[x[pl.REACH : -pl.REACH] != 0].mean()

    net = pl.Network(start)
    seen = np.zeros_like(net.flat)
    assert net.step(x, slice(pl.REACH, len(x) - pl.REACH, 1), seen, 0.0) == 81
    slopes = np.sqrt(seen)
    used = np.flatnonzero(slopes > 1e-3)
    for i in r.choice(used, 40):
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs(abs(loss(up) - loss(down)) / 2e-2 - slopes[i]) < 1e-3


def test_training_lowers_the_loss():
    r = random.Random(4)
    codes = [bytes(1 + (k + s) % 9 for k in range(200)) for s in (r.randint(0, 8) for _ in range(200))]
    mass = np.bincount(np.frombuffer(b"".join(codes), np.uint8), minlength=pl.CLASSES)
    flat = pl.Network.start(mass).flat
    x, _ = pl.line_of(codes)
    before = pl.Network(flat).log_probabilities(x)[x[2:-2] != 0].mean()
    for turn in range(pl.ROUNDS):
        n, flat = pl._trained_cell(codes, flat, turn)
        assert n == 20_000
    assert pl.Network(flat).log_probabilities(x)[x[2:-2] != 0].mean() > before + 1


def test_empty_table(spark):
    assert pl.scored(fx.documents(spark, [])).count() == 0
    assert [tuple(r) for r in pl.scored(fx.documents(spark, [(1, None, "en", "a")])).collect()] == [(1, 0, 0.0, None, 0, None)]


def test_memory_holds_every_window_rare_words_too(spark, monkeypatch):
    """As the settings stand, all tokens of a text are windows, and all of a repeated text's are met, those of rare words included."""
    monkeypatch.setattr(pl, "WORDS", 60)
    monkeypatch.setattr(pl, "CHUNK", 500)
    docs = documents(spark)
    top, _, mass = pl.classed(pl.word_counts(docs))
    flat = pl.trained(pl.coded(docs, top, mass).cache(), mass, 512)
    got = ordered(map(tuple, pl.scored(docs, 512).collect()))
    want = ordered(brute([(r["doc_id"], r["text"]) for r in docs.collect()], flat))
    assert len(got) == len(want) and all(near(g, w) for g, w in zip(got, want))
    assert all(g[4] == g[1] for g in got) and all(g[5] == 1 for g in got if g[0] is not None and (g[0] < 8 or 100 <= g[0] < 108))


def test_messages_are_small(spark):
    """What parts of the memory answer takes a few bytes for each window, so that an executor holds little of it at once."""
    docs = documents(spark)
    top, _, mass = pl.classed(pl.word_counts(docs))
    answers = pl.answered(pl.sent(pl.coded(docs, top, mass).cache(), 4)).collect()
    assert answers and sum(len(r["seen"]) + len(r["windows"]) for r in answers) < 4 * mass.sum()
    for kind, values in ((np.uint64, [0, 2**64 - 1]), (np.uint32, [2**32 - 1]), (np.int64, [255]), (np.int64, [256, 3]), (np.int64, [65_536]), (np.int64, [2**40, 1]), (np.int64, [])):
        a = np.array(values, dtype=kind)
        assert pl._numbers([pl._bytewise(a), pl._bytewise(a[:0]), pl._bytewise(a[::-1])], kind).tolist() == values + values[::-1]


def test_words_are_those_of_python(spark, monkeypatch):
    monkeypatch.setattr(pl, "WORDS", 3)
    monkeypatch.setattr(pl, "_FLUSH", 20)
    monkeypatch.setattr(pl, "_PASSED", 4)
    texts = ["b b b a", None, "", "İX ΟΔΟΣ Straße\x1cx y z \U0001d400\U0001f600 é", " \x85\n", "b b b b b ​ q", "a a A", "ΟΔΟΣ z"]
    docs = fx.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    counts = Counter(w for t in texts for w in (t or "").lower().split())
    assert {r["word"]: r["n"] for r in pl.word_counts(docs).collect()} == counts
    top, _, mass = pl.classed(pl.word_counts(docs))
    assert [w for w, _ in top] == ["b", "a"]
    own = pl.Vocabulary((w, i << 8 | i + 1) for i, (w, _) in enumerate(top))
    for r in pl.coded(docs, top, mass).collect():
        words = (texts[r["doc_id"]] or "").lower().split()
        got = [sum(r[f"byte{k}"][i] << 8 * k for k in range(4)) << 8 | r["codes"][i] for i in range(len(words))]
        assert len(r["codes"]) == r["n"] == len(words) and r["rare"] == [w for w in words if w not in own]
        assert [g for g, w in zip(got, words) if w in own] == [own[w] for w in words if w in own]
        assert [g & 255 for g in got] == [own[w] & 255 for w in words] and all(g >> 8 >= pl.WORDS for g, w in zip(got, words) if w not in own)
