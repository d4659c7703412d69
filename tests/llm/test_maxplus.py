import random

import fixtures as fx
import numpy as np
import pytest
from pricestrata.llm import maxplus

P = maxplus.pieces(maxplus.vocabulary_path())


def whole(text):
    """The best segmentation of a whole text, by one plain pass."""
    line = P.normal(text)
    best, back = P.lattice(line, len(line))
    return P.traced(line, back, len(line))[0], best[-1]


def cases():
    r = random.Random(3)
    words = ["the", "tion", "é", "ß", "über", "  ", "\n", "\U0001f600", "▁", "x" * 40, "a b", "\t", "0", "ing", "Ж", "일"]
    yield from ("", " ", "a", "\n\n", "   a  ", "a\x00b", " ", "é", "▁▁")
    for n in (5, 60, 400):
        for _ in range(4):
            yield "".join(r.choice(words) + r.choice(["", " "]) for _ in range(n))
    for n in (40, 300):  # long unbroken runs of few letters have many ties
        for _ in range(4):
            yield "".join(r.choice("aeinst") for _ in range(n))
            yield "".join(r.choice(["an", "in", "er", "the", "s", "1", "11"]) for _ in range(n))


@pytest.mark.parametrize("text", list(cases()))
def test_parts_equal_one_pass_and_decode(text):
    ids, score = P.encode(text)
    assert (ids.tolist(), score) == whole(text)
    assert P.decode(ids.tolist()) == text.replace("▁", " ")


@pytest.mark.parametrize("chunk", [1, 3, 17, 64])
def test_chunks_equal_one_pass(chunk):
    for text in cases():
        line = P.normal(text)
        cut = [(line[i : i + chunk], line[i + chunk : i + chunk + P.longest - 1]) for i in range(0, len(line), chunk)]
        if not cut:
            continue
        ms = [P.matrix(c, a) for c, a in cut]
        total = ms[0]
        for m in ms[1:]:
            total = maxplus.product(total, m)
        assert total[0, 0] == whole(text)[1]
        entry = maxplus.prefixes(ms, np.where(np.arange(P.longest) == 0, 0.0, -np.inf))[:-1]
        maps = [P.entries(c, a, e) for (c, a), e in zip(cut, entry)]
        at = maxplus.followed(maps, 0)
        assert at[0] == 0 == maxplus.composed(maps)[0]
        ids = np.frombuffer(b"".join(P.back(c, a, e, j) for (c, a), e, j in zip(cut, entry, at[1:])), "<i4").tolist()
        assert ids == whole(text)[0]


def test_maps_compose_like_steps():
    r = np.random.default_rng(2)
    maps = [np.where(r.random(6) < 0.2, -1, r.integers(0, 6, 6)) for _ in range(4)]
    assert maxplus.composed(maps).tolist() == maxplus.composed([maxplus.composed(maps[:2]), maxplus.composed(maps[2:])]).tolist()


def test_product_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (r.normal(size=(5, 5)) for _ in range(3))
    assert np.allclose(maxplus.product(maxplus.product(a, b), c), maxplus.product(a, maxplus.product(b, c)))


def test_giants_equal_small(spark):
    docs = fx.documents(spark, [(i, t, "en", "a") for i, t in enumerate([*cases(), None, "".join(cases()) * 3])] + [(3, "\n\n", "en", "a")])
    small = sorted(map(tuple, maxplus.encoded(docs).collect()), key=str)
    large = sorted(map(tuple, maxplus.encoded(docs, giant=10, chunk=9).collect()), key=str)
    assert small == large
    back = maxplus.decoded(maxplus.encoded(docs, giant=10, chunk=9)).select("doc_id", "text").collect()
    want = [(r["doc_id"], None if r["text"] is None else r["text"].replace("▁", " ")) for r in docs.collect()]
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)


def test_ties_go_to_the_longest_last_piece():
    """By all segmentations of short texts."""
    r = random.Random(9)

    def best(line):
        """(score, ids) of every segmentation's best, preferring longer pieces from the end."""
        out = {0: (0.0, [])}
        for e in range(1, len(line) + 1):
            found = []
            for s in range(e):  # the longest first
                i = P.ids.get(line[s:e])
                if i is not None:
                    found.append((out[s][0] + P.scores[i], out[s][1] + [i]))
                elif e - s == 1:
                    found.append((out[s][0] + P.unknown, out[s][1] + [P.bytes_id.get(b, 0) for b in line[s:e].encode()]))
            top = max(f[0] for f in found)
            out[e] = next(f for f in found if f[0] == top)
        return out[len(line)]

    for _ in range(300):
        text = "".join(r.choice("aeinst1é \u4e00") for _ in range(r.randint(1, 24)))
        score, ids = best(P.normal(text))
        assert (P.encode(text)[0].tolist(), P.encode(text)[1]) == (ids, score)


def test_remembered_parts_are_bounded():
    own = maxplus.Pieces(maxplus.vocabulary_path())
    own.encode("x" * 1000 + " " + "y" * 100)
    assert max(map(len, own.cache)) <= maxplus._CACHED
    own.cached = maxplus._CACHE + 1
    assert own.encode("a b")[0].tolist() == P.encode("a b")[0].tolist() and len(own.cache) < 10


def test_empty_table(spark):
    assert maxplus.decoded(maxplus.encoded(fx.documents(spark, []))).count() == 0
