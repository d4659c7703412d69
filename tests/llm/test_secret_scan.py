import fixtures as fx
from pricestrata.llm import secret_scan as scan

ENC = scan.encoder(scan.vocabulary_path())


def added(text):
    return [text[a:b] for a, _, b, _ in scan.all_spans(text, ENC)[1]]


def test_base_spans_equal_brute_force(spark):
    docs = fx.documents(spark)
    want = sorted(((r["doc_id"], fx.joined(fx.secrets(r["text"] or ""))) for r in docs.collect()), key=str)
    got = scan.scanned(docs).collect()
    assert sorted(((r["doc_id"], r["base"]) for r in got), key=str) == want
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got)
    assert any(r["n_random"] for r in got)


def test_random_strings_are_found_and_known_ones_are_not():
    assert added("key k9XzQ2vLr8TnW4bYp0JfHs7DcGm3Ae end") == ["k9XzQ2vLr8TnW4bYp0JfHs7DcGm3Ae"]
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "internationalization_of_everything_2", "a" * 5000, "1" * 40, "antidisestablishmentarianism", "version_2_of_the_long_parameter_name"):
        assert added(f"x {fine} y") == []


def test_documents_without_secrets_keep_every_column(spark):
    docs = fx.documents(spark)
    kept = scan.without_secrets(docs)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if not any(scan.all_spans(r["text"] or "", ENC))]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and 0 < len(want) < docs.count()


def test_empty_table(spark):
    assert scan.scanned(fx.documents(spark, [])).count() == 0


def test_keys_are_found_beside_names_and_paths_and_without_digits():
    key, letters = "k9XzQ2vLr8TnW4bYp0JfHs7D", "kQzXwvLrjTnWqbYpgJfHsxDcGmZA"
    for glued in ("database_connection_credential=", "production/service/credentials/", "the-name-of-the-long-service-", "a_very_long_parameter_name_"):
        assert [x[-len(key) :] for x in added(f"x {glued}{key} y")] == [key], glued
    assert added(f"x {letters} y") == [letters]
    assert [x[-len(letters) :] for x in added(f"x database_connection_credential={letters} y")] == [letters]
    for fine in ("production/service/credentials/of/everything", "getUserAccountInformation"):
        assert added(f"x {fine} y") == []
