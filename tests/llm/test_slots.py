from collections import Counter

import fixtures as fx
import pytest
from pricestrata.llm import slots


def run(spark, docs, shards=slots.SHARDS):
    versions = slots.slot_maps(shards + 1)
    maps = slots.map_table(spark, {v: versions[v - 1] for v in (shards, shards + 1)})
    return slots.shard_records(slots.records(docs), maps, shards).collect()


def test_maps_only_hand_slots_to_the_new_shard():
    versions = slots.slot_maps(30)
    for n, (old, new) in enumerate(zip(versions, versions[1:]), 2):
        assert all(a == b or b == n - 1 for a, b in zip(old, new))
        sizes = Counter(new).values()
        assert len(sizes) == n and max(sizes) - min(sizes) <= 1


def test_rebalancing_moves_few_slots_and_evens_out_bytes():
    now = slots.slot_maps(4)[-1]
    sizes = {s: 1000 if now[s] == 0 else 500 for s in range(slots.SLOTS)}
    new = slots.rebalanced(now, sizes, 4)
    load = Counter()
    for s, shard in enumerate(new):
        load[shard] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 1000
    assert all(a == b or a == 0 for a, b in zip(now, new))
    assert slots.rebalanced(new, sizes, 4) == new
    assert slots.rebalanced([0] * 8, {}, 2) == [0] * 8


def test_awkward_documents(spark):
    docs = fx.documents(spark)
    rows = run(spark, docs)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, fx.crc(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_id_and_shard_count_decide(spark):
    docs = fx.documents(spark)
    other = docs.where("doc_id % 2 = 0").withColumn("text", docs["source"])
    shard = {r["doc_id"]: r["shard"] for r in run(spark, docs)}
    assert all(shard[r["doc_id"]] == r["shard"] for r in run(spark, other))
    grown = {r["doc_id"]: r["shard"] for r in run(spark, docs, 25)}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in run(spark, docs))


def test_empty_table(spark):
    assert run(spark, fx.documents(spark, [])) == []


def test_a_stored_map_is_read_again_and_edited_by_bytes(spark, tmp_path):
    path = str(tmp_path / "map")
    first = slots.stored_maps(spark, path, 4, 64).collect()
    assert sorted({r["version"] for r in first}) == [4, 5]
    slots.write_map(spark, path, 5, [0] * 64)  # what is there is read, and not made again
    assert {r["shard"] for r in slots.stored_maps(spark, path, 4, 64).where("version = 5").collect()} == {0}
    docs = spark.createDataFrame([(i, "x" * (2000 if i % 7 == 0 else 10)) for i in range(400)], "doc_id long, text string")
    rows = slots.records(docs, 64)
    bytes_of = {r["vslot"]: r["slot_bytes"] for r in slots.slot_sizes(rows).collect()}
    load = lambda v: [sum(bytes_of.get(r["vslot"], 0) for r in slots.read_map(spark, path, v).collect() if r["shard"] == s) for s in range(4)]
    own = str(tmp_path / "bytes")
    slots.write_map(spark, own, 1, slots.slot_maps(4, 64)[3])
    path = own
    assert slots.rebalance(spark, own, 1, slots.slot_sizes(rows), 4, 64) == 2
    assert max(load(2)) - min(load(2)) < max(load(1)) - min(load(1)) and sum(load(2)) == sum(load(1))
    with pytest.raises(ValueError, match="is there"):
        slots.rebalance(spark, own, 1, slots.slot_sizes(rows), 4, 64)


def test_places_of_a_hot_null_id_and_of_repeated_rows(spark):
    """Most rows have no id; they, and equal rows, have gapless places in the order of slot, id, checksum and size."""
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 50}") for i in range(900)], "doc_id long, text string").repartition(7)
    got = slots.shard_records(slots.records(docs), slots.map_table(spark, {v: slots.slot_maps(5)[v - 1] for v in (4, 5)}), 4).collect()
    assert len(got) == 900
    for shard in {r["shard"] for r in got}:
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["virtual_slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in own]
        assert order == sorted(order)
