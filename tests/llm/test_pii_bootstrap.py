import random

import fixtures as fx
from pricestrata.llm import pii_bootstrap as pii


def test_base_spans_equal_brute_force(spark):
    r = random.Random(9)
    noise = ["".join(r.choice("a1.@+- _%()é\x01\x02\n5555\U0001f600") for _ in range(r.randint(0, 80))) for _ in range(400)]
    cards = [" ".join(r.choice(["4111", "-1111", "1111 1111", "5", "+", "(1)"]) for _ in range(8)) for _ in range(100)]
    docs = fx.documents(spark, fx.awkward() + [(1000 + i, t, "en", "a") for i, t in enumerate(noise + cards)])
    got = pii.counted(pii.extracted(docs)).collect()
    want = []
    for row in docs.collect():
        s = fx.pii(row["text"] or "")
        want.append((row["doc_id"], *(sum(k == kind for *_, k in s) for kind in pii.KINDS[:4]), fx.sha(fx.joined(s))))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"some words here, contact: u{i}@mail{i}.example.org and more text follows", "en", "a") for i in range(20)]
    rows += [(100, "\U0001f600 contact: user-4821-77 and more", "en", "a"), (101, "the order 4821-9922 was sent", "en", "a"), (102, "nothing here", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.counted(pii.extracted(fx.documents(spark, rows))).collect()}
    assert got[100] == "context:11:23" and got[101] == "" and got[102] == ""


def test_common_words_are_no_patterns(spark):
    rows = [(i, f"the the the the the the u{i}@mail.example.org the the", "en", "a") for i in range(20)] + [(100, "the 4821-9922 the", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.counted(pii.extracted(fx.documents(spark, rows))).collect()}
    assert got[100] == ""


def test_empty_table(spark):
    assert pii.counted(pii.extracted(fx.documents(spark, []))).count() == 0


def test_identifiers_without_four_digits_in_a_row_and_rows_without_an_id(spark):
    rows = [(i, f"some words here, contact: u{i}@mail{i}.example.org and more text follows", "en", "a") for i in range(20)]
    rows += [(100, "contact: 482-917-553 x", "en", "a"), (None, "contact: 48-21-77-x9 x", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.counted(pii.extracted(fx.documents(spark, rows))).collect()}
    assert got[100] == "context:9:20" and got[None] == "context:9:20"


def test_contexts_glued_to_their_identifiers(spark):
    rows = [(i, f"x contact:u{i}@mail{i}.example.org z{i}", "en", "a") for i in range(20)] + [(100, "y contact:user-4821-77 q", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.counted(pii.extracted(fx.documents(spark, rows))).collect()}
    assert got[100] == "context:10:22"


def test_uses_in_all_documents_count_against_a_pattern(spark):
    rows = [(i, f"a note u{i}@mail{i}.example.org z{i}", "en", "a") for i in range(20)] + [(50 + i, "a note of words", "en", "a") for i in range(20)] + [(100, "note 4821-9922 q", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.counted(pii.extracted(fx.documents(spark, rows))).collect()}
    assert got[100] == ""
