"""The queries as registered, over the driver's smallest tables."""

import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import fixtures as fx
import pytest
from pricestrata.llm import langid, maxplus, poisson_mix, queries, secret_scan

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(str([r[c] for c in sorted(columns)]) for r in df.collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_hilbert_windows", ["query_id long", "rank int", "vec_id long", "score double"]),
    ("op3_virtual_slots", ["doc_id long", "size long", "text_crc32 long", "law string", "shard int", "slot long", "grown_shard int"]),
    ("op6_word_backoff_langid", ["doc_id long", "held_out boolean", "lang_pred string", "score double"]),
    ("op7_bootstrapped_pii", ["doc_id long", "n_email long", "n_ip long", "n_card long", "n_phone long", "base_sha256 string", "spans string"]),
    ("op8_token_efficiency_secrets", ["doc_id long", "n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string"]),
    ("op11_vantage_annulus_negatives", ["anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long"]),
    ("op12_nb_svm_quality", ["doc_id long", "held_out boolean", "score double", "predicted int"]),
    ("op13_exact_scatter_whitening", ["vec_id long", "component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]),
    ("op9_simhash_components", ["doc_id long", "fingerprint string", "component_id long"]),
])
def test_contracts(spark, name, columns):
    df = queries.queries()[name](spark, DATA)
    kinds = {c: {"bigint": "long"}.get(t, t) for c, t in df.dtypes}
    assert [f"{c} {kinds[c]}" for c in (x.split()[0] for x in columns)] == columns


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries.op6_word_backoff_langid(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in got) / len(got) > 0.98


def brute_pipeline(rows, model):
    rows = [r for r in rows if (p := model.predict(r["text"], {}))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    rows = [rows[i] for i in fx.near_firsts(rows)]
    enc = secret_scan.encoder(secret_scan.vocabulary_path())
    rows = [r for r in rows if not any(secret_scan.all_spans(r["text"], enc))]
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"].encode())
    weight = {s: b**poisson_mix.TEMPERATURE for s, b in size.items()}
    rate = {s: w / sum(weight.values()) * sum(size.values()) / size[s] for s, w in weight.items()}
    out = []
    pieces = maxplus.pieces(maxplus.vocabulary_path())
    import hashlib
    import math

    for r in rows:
        key = hashlib.md5(f"{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
        u = int(hashlib.md5(f"{key}:{poisson_mix.SEED}:0".encode()).hexdigest()[:13], 16) / 2**52
        m, n = rate[r["source"]], 0
        p = c = math.exp(-m)
        while c <= u:
            n += 1
            p *= m / n
            c += p
        ids, score = pieces.encode(r["text"])
        if r["doc_id"] is not None:  # rows without an id draw by their place in the table
            out += [(r["doc_id"], zlib.crc32(ids.tobytes()), score)] * n
    return sorted(out)


def shown(df):
    import numpy as np

    return sorted((r["doc_id"], zlib.crc32(np.array(r["ids"], "<i4").tobytes()), r["score"]) for r in df.collect() if r["doc_id"] is not None)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learnt(docs)
    assert shown(corpus_pipeline.run(spark, DATA)) == brute_pipeline([r.asDict() for r in docs.collect()], model)


def test_pipeline_on_awkward_and_empty_documents(spark, tmp_path):
    rows = [*fx.awkward(), (4, "another text of enough words under an id that is known already", "en", "a"), (None, None, "en", "a")]
    docs = fx.documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.learnt(docs)
    assert shown(corpus_pipeline.run(spark, str(tmp_path))) == brute_pipeline([r.asDict() for r in docs.collect()], model)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, "")
        assert step.columns == docs.columns
    fx.documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone has the repository on its path; it runs elsewhere."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "kept")!r}).getOrCreate()
from pricestrata.llm import chroma, langid, maxplus, pseudo_likelihood, secret_scan, simhash_dedup
docs = spark.createDataFrame([(i, "some words of text number %d and more" % (i // 2), "en", "a") for i in range(20)], "doc_id long, text string, lang string, source string")
found = [langid.identified(docs), langid.clear(docs, langid.learnt(docs), 0.1), pseudo_likelihood.scored(docs), maxplus.decoded(maxplus.encoded(docs, giant=10, chunk=8)),
         secret_scan.scanned(docs), simhash_dedup.firsts(docs), simhash_dedup.deduplicated(docs), chroma.matched(docs, F.col("text"), F.col("rec_id") % 2 == 0)]
print("counts", [df.count() for df in found])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "counts [20, 20, 20, 20, 20, 10, 20, 20]" in out.stdout, out.stderr[-3000:]
