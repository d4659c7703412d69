import fixtures as fx
import numpy as np
from pricestrata.llm import chroma
from pyspark.sql import functions as F


def tones(seconds, seed):
    r = np.random.default_rng(seed)
    n = int(chroma.RATE * seconds)
    notes = 220 * 2 ** (r.integers(0, 36, int(seconds * 40) + 1) / 12)
    return np.sin(2 * np.pi * np.cumsum(np.repeat(notes, chroma.RATE // 40 + 1)[:n]) / chroma.RATE)


def pcm(x):
    return bytes(np.clip(np.round(x * 100 + 128), 0, 255).astype(np.uint8))


def plain(frames):
    """packed(), by sums over boxes."""
    out = []
    for t in range(len(frames) - chroma.WIDTH + 1):
        word = 0
        for boxes, threshold in chroma.filters():
            area = lambda sign: sum(frames[t + a : t + b, y:z].sum() for s, a, b, y, z in boxes if s == sign)  # noqa: B023, E731
            v = round(float(np.log1p(area(1)) - np.log1p(area(-1))), 9)
            word = word << 2 | (0 if v <= -threshold else 1 if v <= 0 else 3 if v <= threshold else 2)
        out.append(word)
    return out


def test_a_tone_falls_into_its_pitch_class():
    x = np.sin(2 * np.pi * 880 * np.arange(4000) / chroma.RATE)
    assert (chroma.chroma(x).argmax(axis=1) == 0).all()
    assert chroma.chroma(np.zeros(4000)).max() == 0


def test_packed_integers_equal_plain_sums():
    frames = chroma.chroma(tones(1.0, 1))
    assert chroma.packed(frames).tolist() == plain(frames)


def test_recordings_and_their_alignments(spark):
    song, other = tones(8, 1), tones(8, 2)
    hop = chroma.HOP
    rows = [(0, song), (1, song), (2, song[hop * 50 :]), (3, np.concatenate((other[: hop * 30], song[: hop * 400]))), (4, other), (5, song + np.random.default_rng(3).normal(0, 0.01, len(song)))]
    media = [(i, pcm(x), 1) for i, x in rows] + [(100, None, 1), (200, b"", 1), (300, pcm(song), 1), (0, pcm(song), 1), (None, pcm(song), 1), (None, None, 1)]
    docs = spark.createDataFrame(media, "doc_id long, media binary, votes int")
    got = chroma.matched(docs, F.col("media"), F.col("rec_id") % 100 == 0).collect()
    assert len(got) == len(media)
    by = {r["rec_id"]: r for r in got if r["rec_id"] is not None}
    assert by[0]["members"] == 5 == by[300]["members"] and by[1]["class_id"] == by[300]["class_id"] == 0
    assert by[0]["links"] == 3 == by[0]["linked_recordings"] and by[1]["links"] is None and by[100]["class_id"] is None is by[200]["links"]
    assert by[0]["best_class"] == 5 and by[0]["offset"] == 0 and by[0]["length"] > by[2]["n_hashes"] and 0 < by[0]["bit_errors"] < 0.2
    _, classes = chroma.classes(chroma.fingerprints(docs, F.col("media")))
    found = {(r["query_class"], r["class_id"]): r for r in chroma.alignments(classes.where("class_id = 0"), classes).collect()}
    assert set(found) == {(0, 2), (0, 3), (0, 5)}
    assert found[0, 2]["offset"] == 50 and found[0, 2]["start"] == 50 and found[0, 2]["bit_errors"] == 0
    assert found[0, 3]["offset"] == -30 and found[0, 3]["segment_errors"] < 0.1 and found[0, 3]["length"] > 350
    assert found[0, 5]["offset"] == 0 and found[0, 5]["segment_errors"] < 0.2


def brute(a, b):
    """compared(), by loops over all places."""
    single = max(len(a), len(b)) <= chroma.SHORT
    none = chroma.silence()
    mark = lambda h, i: None if h[i] == none or not single and (i + chroma.APART >= len(h) or h[i + chroma.APART] == none) else h[i] if single else (h[i], h[i + chroma.APART])
    votes = {}
    for i in range(len(a)):
        for j in range(len(b)):
            if mark(a, i) is not None and mark(a, i) == mark(b, j):
                votes[i - j] = votes.get(i - j, 0) + 1
    if not votes:
        return None
    offset = max(votes, key=lambda o: (votes[o], -abs(o), -o))
    places = [i for i in range(len(a)) if 0 <= i - offset < len(b)]
    bits = [(a[i] ^ b[i - offset]).bit_count() for i in places]
    best = (0, 0, 0)
    for i in range(len(bits)):
        total = 0
        for j in range(i, len(bits)):
            total += chroma.MOST_BITS - bits[j]
            if total > best[0]:
                best = (total, i, j + 1)
    _, i, j = best
    wrong = sum(bits[i:j])
    if j - i < min(chroma.LEAST, (max(len(a), len(b)) + 1) // 2) or wrong > chroma.ERROR * 32 * (j - i):
        return None
    return offset, votes[offset], len(bits), round(sum(bits) / 32 / len(bits), 9), places[0] + i, j - i, round(wrong / 32 / (j - i), 9)


def test_alignments_equal_brute_force(spark):
    """Offsets, votes, overlaps, bit errors and segments over awkward texts, near copies, repeats, silence and short ones."""
    r = np.random.default_rng(8)
    text = lambda n: "".join(r.choice(list("abcdefghij klmnopq rstuv"), n))
    base, line = text(3000), text(64 * 3)
    more = [base, base[:1500] + "X" + base[1501:], base[:1400] + text(1600), base[640:], line * 20, line * 30 + base[:800], "a" * 5000, "a" * 6000, text(800)]
    more += [more[-1] + "tail of it", more[-1][:760], base[:1000], base[:1010], text(900), text(64 * 5) + base]
    docs = fx.documents(spark, [*fx.awkward(), *((100 + 4 * i, t, "en", "a") for i, t in enumerate(more))])
    prints = {}
    for row in docs.collect():
        h = chroma.packed(chroma.chroma(chroma.samples_of((row["text"] or "").encode()))).tolist()
        prints.setdefault(tuple(h), []).append(row["doc_id"])
    first = {h: min((i for i in ids if i is not None), default=None) for h, ids in prints.items() if h}
    members = {first[h]: len(ids) for h, ids in prints.items() if h}
    asked = {c for h, c in first.items() if any(i is not None and i % 4 == 0 for i in prints[h])}
    want = {}
    for a, p in first.items():
        for b, q in first.items():
            if p in asked and q is not None and p != q and (found := brute(list(a), list(b))):
                want[p, q] = found
    rows, by = chroma.classes(chroma.fingerprints(docs, F.col("text")))
    got = chroma.alignments(by.where(F.col("class_id").isin(sorted(asked))), by).collect()
    assert len(want) > 20 and {(x[0], x[1]): (*x[2:5], round(x[5], 9), *x[6:8], round(x[8], 9)) for x in map(tuple, got)} == want
    told = chroma.matched(docs, F.col("text"), F.col("rec_id") % 4 == 0).collect()
    assert len(told) == docs.count()
    for t in told:
        if t["is_query"] and t["n_hashes"]:
            own = [q for p, q in want if p == t["class_id"]]
            assert t["links"] == len(own) and t["linked_recordings"] == sum(members[q] for q in own)
            if own:
                q = min(own, key=lambda q: (-want[t["class_id"], q][5], want[t["class_id"], q][6], q))
                assert t["best_class"] == q and t["offset"] == want[t["class_id"], q][0]


def test_votes_of_marks_that_repeat_equal_plain_ones():
    rng = np.random.default_rng(3)
    other = rng.integers(0, 1 << 32, 300)
    for a, b in ((np.concatenate((np.full(900, 77), other)), np.concatenate((other[:100], np.full(700, 77)))), (np.full(400, 5), np.full(900, 5)), (rng.integers(1, 3, 4000), rng.integers(1, 3, 3000))):
        (m, p), (n, q) = chroma.marks(a), chroma.marks(b)
        assert len(chroma._repeated(m, n, len(a) + len(b)))
        want = np.unique((p[:, None] - q[None, :])[m[:, None] == n[None, :]], return_counts=True)
        assert chroma.histogram(a, b) == dict(zip(*(x.tolist() for x in want)))
    hum = np.full(300_000, 9)
    assert chroma.compared(hum, hum)[:3] == (0, 300_000 - chroma.APART, 300_000)


def test_music_tells_low_semitones_and_aligns(spark):
    sound = chroma.MUSIC
    for n in range(-36, 24):  # from 55 Hz up
        x = np.sin(2 * np.pi * 440 * 2 ** (n / 12) * np.arange(3 * sound.rate) / sound.rate)
        assert (chroma.chroma(x, sound.rate, sound.frame, sound.hop).argmax(axis=1) == n % 12).all()
    rng = np.random.default_rng(5)

    def tune(seconds):
        notes = 110 * 2 ** (rng.integers(0, 36, seconds * 4) / 12)
        return np.sin(2 * np.pi * np.cumsum(np.repeat(notes, sound.rate // 4)) / sound.rate)

    song, other = tune(30), tune(30)
    noisy = song[10 * sound.rate : 25 * sound.rate] + rng.normal(0, 0.05, 15 * sound.rate)
    rows = [(0, song), (1, noisy), (2, other)]
    docs = spark.createDataFrame([(i, bytearray((np.clip(x, -1, 1) * 30_000).astype("<i2").tobytes() + b"x")) for i, x in rows] + [(3, None)], "doc_id long, media binary")
    got = {r["rec_id"]: r for r in chroma.matched(docs, F.col("media"), F.col("rec_id") >= 0, sound=sound).collect()}
    assert got[0]["best_class"] == 1 and got[1]["best_class"] == 0 and got[2]["links"] == 0 and got[3]["n_hashes"] == 0
    assert abs(got[0]["offset"] * sound.hop - 10 * sound.rate) < sound.frame and got[0]["length"] > 90


def test_empty_table(spark):
    assert chroma.matched(fx.documents(spark, []), F.col("text"), F.col("rec_id") % 100 == 0).count() == 0
