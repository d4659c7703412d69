"""The queries opN_<name>: every operator over its whole table with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, hard_negatives, hilbert_ann, langid, maxplus, pii_bootstrap, poisson_mix, pseudo_likelihood, quality, secret_scan, simhash_dedup, slots, whitening
from .common import kept, shared_dir, table


def op1_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound: a document's UTF-8 bytes are the samples. Queries are the rows whose id is divisible by 100."""
    found = chroma.matched(table(spark, sf_dir, "documents"), F.col("text"), F.col("rec_id") % 100 == 0)
    errors = [F.round(c, 6).alias(c) for c in ("bit_errors", "segment_errors")]
    return found.select(F.col("rec_id").alias("doc_id"), *[c for c in found.columns[1:] if not c.endswith("errors")], *errors)


def op2_hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(slots.records(table(spark, sf_dir, "documents")))
    maps = slots.stored_maps(spark, f"{shared_dir(spark)}/slot-map-{slots.SLOTS}", slots.SHARDS)
    return slots.shard_records(rows, maps, slots.SHARDS)


def op4_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key")


def op5_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_pieces, a hash of the ids, their score, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    out = maxplus.decoded(maxplus.encoded(docs))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


def op6_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.counted(pii_bootstrap.extracted(table(spark, sf_dir, "documents")))


def op8_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, sf_dir, "documents"))


def op11_vantage_annulus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; a seventh of the labels is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


def op12_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_scatter_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _op3_sql() -> str:
    """The checksum runs over a text's bits, lowest first, by the reversed polynomial."""
    n = slots.SHARDS
    versions = slots.slot_maps(n + 1)
    return f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {slots.OVERHEAD} AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % {slots.SLOTS} AS v,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: list_transform(range(8), lambda k: (('0x' || h)::BIGINT >> k) & 1)))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) AS crc
  FROM documents),
m AS (SELECT unnest(range({slots.SLOTS})) AS v, unnest({versions[n - 1]}) AS shard, unnest({versions[n]}) AS grown)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY v, doc_id, crc, size) - 1 AS slot, grown AS grown_shard, v AS virtual_slot, (sum(size) OVER (PARTITION BY v))::BIGINT AS slot_bytes, {n} AS map_version
FROM r JOIN m USING (v)"""


def _op4_sql() -> str:
    bytes_of = "octet_length(encode(coalesce(text, '')))"
    return f"""
WITH RECURSIVE s AS (SELECT source, sum({bytes_of})::BIGINT AS b FROM documents GROUP BY source HAVING sum({bytes_of}) > 0),
w AS (SELECT source, b, pow(b::DOUBLE, {poisson_mix.TEMPERATURE}) AS w FROM s),
r AS (SELECT source, w / (SELECT sum(w::DECIMAL(38, 12))::DOUBLE FROM w) * (SELECT sum(b)::BIGINT FROM w) / b AS rate FROM w),
t AS (SELECT source, rate, greatest(ceil(rate / {poisson_mix.MEAN}), 1)::INT AS parts, rate / greatest(ceil(rate / {poisson_mix.MEAN}), 1) AS m FROM r),
c(source, k, p, c) AS (SELECT source, 0, exp(-m), exp(-m) FROM t UNION ALL SELECT t.source, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE k < ceil(m + 12 * sqrt(m) + 30)),
u AS (SELECT doc_id, d.source, rate, key, ('0x' || substr(md5(key || ':{poisson_mix.SEED}:' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT doc_id, d.source, rate, md5(doc_id || ':' || md5(coalesce(text, ''))) AS key, unnest(range(parts)) AS j FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source) d),
n AS (SELECT doc_id, u.source, rate, key, count(*) FILTER (c <= u) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, round(rate, 9) AS mix_rate, n::INT AS mix_copies, i::INT AS mix_copy, md5('order:' || key || ':{poisson_mix.SEED}:' || i) AS mix_key FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0)"""


def _op11_sql() -> str:
    """All products of anchors and rows."""
    n = hard_negatives
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({n.SCALE} * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
q AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= {n.POSITIVES}),
m AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, s AS negative_score
  FROM q JOIN p USING (anchor_id) WHERE NOT same AND {n.LOW} * positive_score <= 100 * s AND 100 * s <= {n.HIGH} * positive_score)
SELECT * FROM m WHERE rank <= {n.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; it assumes distinct ids. The others are tested against brute force."""
    return {"op3_virtual_slots": _op3_sql(), "op4_poisson_mixture": _op4_sql(), "op11_vantage_annulus_negatives": _op11_sql()}
