"""SimHash fingerprints, linked by deletion-variant signatures.

A fingerprint has 64 bits, one for each bit of the XXH64 (seed 42) of a text's word shingles. Two
fingerprints link at RADIUS differing bits or fewer. The bits are cut into so few segments that in
any such pair a segment (or a choice of several) differs by one bit at most: both then share a
variant of it with one bit left out. An equality join on these variants finds every pair, and
counting the differing bits verifies it.

Within a variant's bucket each fingerprint is first held against the LAGS before it in their order,
which is every pair of a small bucket. Components of these links leave only pairs across components
of larger buckets to be compared, so thousands of near copies cost a sort and not a square. Every link that joins two components is found, which is all that
components need.

A contract's fingerprints of shingles at a small radius cannot tell all texts that share four fifths of
their shingles: such pairs differ in 3 to 14 of 64 bits. near_copies() therefore takes its candidates
from a longer fingerprint, PRINTS times 64 bits, of a text's distinct words, of which near copies share far
more: pairs at 0.8 differ in 4 bits of 64 on average, or in 9 if one is the other without its last fifth.
Candidates agree in all bits of a band: bands are fixed sets of bits drawn from the whole of it. At 9 bits
of 64 a band of 21 bits finds as many pairs a key as five deletion variants of a segment of that length, so there are
fewer than half the keys to move. In texts that are not short little words don't count, which strangers of one language share, unless
nearly all words are little. Candidates whose sets of distinct five-word shingles have a
Jaccard similarity of 0.8 or more, counted on whole texts, link; no others do.

Nulls and texts of no words have the fingerprint zero, which links like any other. Repeated rows
have equal fingerprints. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, kept, swept

WORDS = 4
RADIUS = 4
LAGS = 4
SEED = 42
_BLOCK = 1 << 15

#: near_copies(): words of a shingle, fingerprints of a text; a short text has FEW distinct words or fewer; bytes of a little word.
NEAR_WORDS, PRINTS, FEW, LITTLE = 5, 8, 64, 3
#: Of a text's distinct words so large a part at least (one in so many) is to be larger than little, or little words count.
LEAST_LARGER = 8
#: 64-bit words of the wide fingerprint; the share of its bits that candidates of few shingles, and of more, may differ in; and how many of its first 64.
WIDE, SHARES, OTHER_BITS = 8, (0.25, 0.22), 19
#: Of a bucket's nodes each is held against so many before it; one in so many signatures comes first; and the share of bits across loose groups.
NEAR_LAGS, FIRST, ACROSS = 2, 16, 0.21
#: Nodes and bytes of sets of a block; two blocks are in a task's memory.
BLOCK_NODES, BLOCK_BYTES = 2048, 16 << 20
_CACHE = 200_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not parts:
        return 0
    line = b" ".join(parts)
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    del parts
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    n = max(1, len(ends) - words + 1)
    last = ends[words - 1 :] or [len(line)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        h = np.array([one(line[a:b], seed) for a, b in zip(starts[i : i + _BLOCK], last[i : i + _BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def cuts(rows: int, radius: int = RADIUS) -> tuple[int, int]:
    """(segments, chosen): any pair within radius agrees, but for one bit at most, in some choice of so many segments.

    The least differing `chosen` of `segments` hold radius * chosen // segments differing bits at most,
    which is one if segments > radius * chosen / 2. More rows take longer signatures, so that few
    strangers share one; every choice finds all pairs within radius.
    """
    chosen = 1 if rows < 4_000_000 else 2 if rows < 200_000_000 else 3
    return radius * chosen // 2 + 1, chosen


def signatures(fp: Column, segments: int, chosen: int) -> Column:
    """The keys of a fingerprint: an array of longs."""
    edge = [round(i * 64 / segments) for i in range(segments + 1)]
    masks = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(segments)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for pick in combinations(range(segments), chosen):
        mask = sum(masks[i] for i in pick)
        keys += [F.xxhash64(F.lit(len(keys) + j), fp.bitwiseAND(F.lit(signed(mask & ~(1 << b))))) for j, b in enumerate(b for b in range(64) if mask >> b & 1)]
    return F.array(*keys)


def bands(rows: int) -> tuple[int, int]:
    """(bits of a band, bands). More rows take longer bands, so that few strangers share one, and more of them, so that recall stays."""
    return (21, 144) if rows < 4_000_000 else (26, 256) if rows < 200_000_000 else (31, 512)


def band_keys(texts: DataFrame, rows: int) -> DataFrame:
    """(node, other, key) of texts (node, prints, wide): a key for each band of each kind of prints that a text has. Kinds never meet."""
    width, number = bands(rows)
    draw, masks = np.random.default_rng(SEED), []
    for band in range(number):
        bits = np.zeros(64 * PRINTS, dtype=np.uint8)
        bits[draw.choice(len(bits), width, replace=False)] = 1
        masks.append((band, np.packbits(bits, bitorder="little").view("<i8").tolist()))
    drawn = F.broadcast(texts.sparkSession.createDataFrame(masks, "band int, mask array<long>"))
    kinds = F.array(*(F.slice("prints", PRINTS * k + 1, PRINTS) for k in range(3)))
    each = dealt(texts.select("node", F.element_at("wide", 1).alias("other"), F.posexplode(kinds).alias("kind", "fp")).where("get(fp, 0) is not null"))
    key = F.xxhash64("kind", "band", *(F.col("fp")[k].bitwiseAND(F.col("mask")[k]) for k in range(PRINTS)))
    return each.crossJoin(drawn).select("node", "other", F.shiftright(key, 32).cast("int").alias("key"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as a shuffle has: few bytes that become many are else one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): distinct fingerprints that link to others, and one fingerprint that names their component."""
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    own = kept(fps.select("fp").distinct())
    segments, chosen = cuts(own.count(), radius)
    by = Window.partitionBy("key")
    keyed = dealt(own).select("fp", F.explode(signatures(F.col("fp"), segments, chosen)).alias("key"))
    # A fingerprint against the LAGS before it: all pairs of a bucket of few, a chain through one of many.
    before = F.filter(F.array(*(F.lag("fp", i).over(by.orderBy("fp")) for i in range(1, LAGS + 1))), lambda x: x.isNotNull() & near(x, F.col("fp")))
    tested = keyed.withColumn("n", F.count("*").over(by)).withColumn("before", before)
    tested = kept(tested.where((F.size("before") > 0) | (F.col("n") > LAGS + 1)))
    first = kept(tested.where(F.size("before") > 0).select(F.explode("before").alias("src"), F.col("fp").alias("dst")).distinct())
    named = kept(components(first).select(F.col("node").alias("fp"), "component"))
    # What is left: pairs across components in the larger buckets.
    held = tested.where(F.col("n") > LAGS + 1).select("key", "fp").join(named, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    held = kept(held.withColumn("a", F.min("component").over(by)).withColumn("b", F.max("component").over(by)).where("a <> b").select("key", "fp", "component"))
    a, b = held.toDF("key", "fp_a", "a"), held.toDF("key", "fp_b", "b")
    across = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near(F.col("fp_a"), F.col("fp_b"))).select(F.col("fp_a").alias("src"), F.col("fp_b").alias("dst")).distinct()
    return components(first.unionAll(across)).select(F.col("node").alias("fp"), "component")


def deduplicated(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    fps = kept(fingerprints(docs, words))
    named = kept(linked(fps, radius))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = first.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(first.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp")


def _mixed(h: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A row of other hashes of h for each of turns, by splitmix64's finaliser."""
    z = h[None, :] + (turns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class _Words(dict):
    """Hashes of words, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        out = xxhash.xxh64_intdigest(word, SEED)
        if len(word) < 64:
            self[word] = out
        return out


def _hashed(text: str | None, words: _Words) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(digest of the words, their hashes, which are little, sorted distinct hashes of the shingles); a text shorter than a shingle is one."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh3_128_digest(b" ".join(parts))
    h = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    little = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) <= LITTLE
    if not parts:
        return digest, h, little, h
    n = max(1, len(h) - NEAR_WORDS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(NEAR_WORDS, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return digest, h, little, np.unique(out)


def _majority(h: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of a set of hashes, one for each of turns, as longs."""
    ones = np.zeros((len(turns), 64), dtype=np.int64)
    for i in range(0, len(h), 512):  # a block's hashes fit the cache
        z = np.ascontiguousarray(_mixed(h[i : i + 512], turns))
        ones += np.unpackbits(z.view(np.uint8).reshape(len(turns), -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.uint16)
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<i8").reshape(len(turns))


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sketch(text: str | None, words: _Words) -> tuple[int, list[int | None], np.ndarray, int]:
    """(node, prints, wide fingerprint of the shingles, their number) of a whole text.

    A print's place in the list says which one it is; those that a text does not have are null. The first PRINTS
    are of all distinct words, for texts of few. PRINTS others leave out words of LITTLE bytes or fewer, which strangers of
    one language share; where most words are little ones, the last PRINTS, of all words, take their place. Texts near a
    border have both kinds, as near copies have 5 / 4 times as many words at most, and as many little ones.
    A text of no words has no prints, so it links to equal texts alone.
    """
    digest, h, little, shingles = _hashed(text, words)
    if not len(h):
        return _node(digest), [], np.zeros(WIDE, np.int64), 0
    every, larger = np.unique(h), np.unique(h[~little])
    prints: list[int | None] = [None] * (3 * PRINTS)
    if len(every) * 4 <= FEW * 5:
        prints[:PRINTS] = _majority(every, np.arange(1, 1 + PRINTS)).tolist()
    if len(every) > FEW and len(larger) * LEAST_LARGER > len(every):
        prints[PRINTS : 2 * PRINTS] = _majority(larger, np.arange(50, 50 + PRINTS)).tolist()
    if len(every) > FEW and len(larger) * LEAST_LARGER <= 2 * len(every):
        prints[2 * PRINTS :] = _majority(every, np.arange(70, 70 + PRINTS)).tolist()
    return _node(digest), prints, _majority(shingles, np.arange(100, 100 + WIDE)), len(shingles)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, prints, wide, size) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, longs = _Words(), pa.list_(pa.int64())
        for b in batches:
            got = [sketch(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), longs, longs, pa.int64())))],
                names=["doc_id", "text_key", "node", "prints", "wide", "size"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, prints array<long>, wide array<long>, size long")


def text_key(text: Column) -> Column:
    """With the id, what tells a row of documents from others but its exact repeats."""
    return F.xxhash64(text.cast("string"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the sorted distinct 64-bit hashes of the shingles of (text), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            got = [_hashed(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(g[0]) for g in got], pa.int64()), pa.array([g[3].tobytes() for g in got], pa.binary())], names=["node", "shingles"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "node long, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of 0.8 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * common >= 4 * (len(a) + len(b))


def alike_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether each set of a is alike each of b: common elements are counted for all pairs at once, by products of incidence matrices."""
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    held = [np.repeat(np.arange(len(side)), n) for side, n in zip((a, b), sizes)]
    flat = [np.concatenate(side) for side in (a, b)]
    shared = np.intersect1d(*flat)
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    at = [np.searchsorted(shared, x) for x in flat]
    there = [(i < len(shared)) & (shared[np.minimum(i, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for i, x in zip(at, flat)]
    for first in range(0, len(shared), 4096):
        parts = []
        for i, row, ok, side in zip(at, held, there, (a, b)):
            here = ok & (i >= first) & (i < first + 4096)
            m = np.zeros((len(side), 4096), dtype=np.float32)
            m[row[here], i[here] - first] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    return 9 * common >= 4 * (sizes[0][:, None] + sizes[1][None, :])


def joined(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of which rows are alike which columns: for each row and each column a row of its component, or -1."""
    rows, none = np.arange(alike.shape[0]), alike.shape[0]
    row, column = rows, np.full(alike.shape[1], none)
    while True:
        column = np.where(alike, row[:, None], none).min(axis=0, initial=none)
        least = np.minimum(row, np.where(alike, column[None, :], none).min(axis=1, initial=none))
        if (least == row).all():
            return np.where(alike.any(axis=1), row, -1), np.where(column < none, column, -1)
        row = least


def verified_groups(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) that join all nodes of a loose group in members (node, loose) whose sets (node, shingles) are alike.

    Groups are cut into blocks of nodes and of bytes, and every two blocks are compared in a task's
    memory, so a group of any size is many bounded tasks; each emits one link a node at most.
    """
    rows = members.join(sets, "node")
    cut = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int")
    rows = rows.join(rows.groupBy("loose").agg(cut.alias("blocks")), "loose")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("loose", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, node = group.column("block").to_numpy(), group.column("node").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(one) and len(two):
            for side, to in zip((one, two), joined(alike_pairs([own[k] for k in one], [own[k] for k in two]))):
                src.append(node[side[to >= 0]])
                dst.append(node[one[to[to >= 0]]])
        src, dst = np.concatenate(src), np.concatenate(dst)
        keep = src != dst
        return pa.table({"src": np.minimum(src, dst)[keep], "dst": np.maximum(src, dst)[keep]})

    return rows.groupBy("loose", "i", "j").applyInArrow(run, "src long, dst long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes whose sets (node, shingles) are alike."""
    both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def apart_in_buckets(rows: DataFrame, texts: DataFrame, loose: DataFrame) -> DataFrame:
    """(node, key, loose, wide) of rows (node, key) whose bucket holds several loose groups.

    A node's keys are gathered first, so that what it is joined with makes a row a node and not one a key.
    """
    by = Window.partitionBy("key")
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys")).join(loose, "node", "left")
    each = keys.select("node", F.coalesce("loose", "node").alias("loose"), F.explode("keys").alias("key"))
    left = each.withColumn("a", F.min("loose").over(by)).withColumn("b", F.max("loose").over(by)).where("a <> b")
    keys = left.groupBy("node", "loose").agg(F.collect_list("key").alias("keys")).join(texts.select("node", "wide"), "node")
    return kept(keys.select("node", F.explode("keys").alias("key"), "loose", "wide"))


def apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose nodes have different components in named (node, component); a node that is not there is its own.

    A node's pairs are gathered first, so that the joins make a row a node and not one a pair.
    """
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    one = pairs.groupBy("src").agg(F.collect_list("dst").alias("others")).join(of("src"), "src", "left")
    each = one.select(F.struct("src", F.coalesce("src_c", "src").alias("c")).alias("one"), F.explode("others").alias("dst"))
    two = each.groupBy("dst").agg(F.collect_list("one").alias("others")).join(of("dst"), "dst", "left")
    left = F.filter("others", lambda x: x["c"] != F.coalesce("dst_c", "dst"))
    return two.select(F.explode(left).alias("one"), "dst").select("one.src", "dst")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, component): documents of one component are near copies, directly or through others.

    Equal texts are one node, named by 64 bits of its digest. Candidates share a band of the
    fingerprint of their distinct words, and differ in few bits of the wide fingerprint of
    their shingles (its first word goes with the band); those whose shingle sets are alike link.
    A few bands of every node come first. What the wide fingerprint lets pass makes loose groups, of texts
    alike and almost alike, and these few bands join most of a large one. Then all pairs of a small
    bucket are tested, and in larger ones each node with the one before it, unless one loose group holds
    both: so a large group brings some pairs a node, and not one for each band. Where a loose group holds
    several components, every two of its nodes are compared, in blocks; in larger buckets every two of
    different loose groups are, by a join. After each large step the driver collects its garbage: plans and
    accounts of what is done with would else fill its memory.
    """
    own = kept(sketches(docs))
    texts = kept(own.groupBy("node").agg(F.min("text_key").alias("text_key"), *(F.any_value(n).alias(n) for n in ("prints", "wide", "size"))))
    by = Window.partitionBy("key")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= OTHER_BITS
    pair = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    keyed = band_keys(texts, texts.count())

    def preceded(rows: DataFrame, order: list, lags: int) -> DataFrame:
        """rows with before: the nodes among the lags before each in its bucket that may be near it."""
        before = F.array(*(F.lag(F.struct("node", "other"), i).over(by.orderBy(*order)) for i in range(1, lags + 1)))
        fit = F.filter(before, lambda x: x.isNotNull() & near(x["other"], F.col("other")))
        return rows.withColumn("before", F.transform(fit, lambda x: x["node"]))

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.select("node", F.explode("before").alias("x")).select(*pair(F.col("x"), F.col("node"))).distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        keys = texts.join(nodes, "node", "left_semi").select("text_key")
        named = docs.select(text_key(F.col("text")).alias("text_key"), "text").join(keys, "text_key", "left_semi")
        return kept(shingle_sets(named).dropDuplicates(["node"]))

    def tested(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those of the distinct pairs that the wide fingerprint lets pass, and those that link."""
        side = lambda c: texts.select(F.col("node").alias(c), F.struct("wide", "size").alias(f"{c}_t"))
        differ = F.aggregate(F.zip_with("src_t.wide", "dst_t.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        least, most = F.least("src_t.size", "dst_t.size"), F.greatest("src_t.size", "dst_t.size")
        share = F.when(least < FEW, SHARES[0]).otherwise(SHARES[1])
        fit = (5 * least >= 4 * most) & (differ <= 64 * WIDE * share)  # 0.8 implies the sizes
        some = kept(pairs.join(side("src"), "src").join(side("dst"), "dst").where(fit).select("src", "dst"))
        sets = sets_of(some.select(F.col("src").alias("node")).unionAll(some.select(F.col("dst").alias("node"))).distinct())
        out = kept(verified(some, sets))
        discard(sets)
        swept(docs.sparkSession)
        return some, out

    many = F.col("n") > NEAR_LAGS + 1
    held = preceded(keyed.withColumn("n", F.count("*").over(by)), ["node"], NEAR_LAGS)
    held = held.withColumn("before", F.when(many, F.slice("before", 1, 1)).otherwise(F.col("before")))
    held = kept(held.where(many | (F.size("before") > 0)))
    some, links = tested(kept(pairs_of(held.where(F.col("key") % FIRST == 0))))
    # Nodes of one loose group need no further pairs: verified_groups() compares every two of them if they don't link already.
    loose = kept(components(some))
    more, found = tested(kept(apart(pairs_of(held), loose)))
    discard(loose)
    some, links = some.unionAll(more), links.unionAll(found)
    named = kept(components(links))
    loose = kept(components(some).withColumnRenamed("component", "loose"))
    swept(docs.sparkSession)
    both = loose.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = both.groupBy("loose").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    members = kept(both.join(several, "loose", "left_semi").select("node", "loose"))
    if not members.isEmpty():
        links = links.unionAll(kept(verified_groups(members, sets_of(members.select("node")))))
        named = kept(components(links))
        swept(docs.sparkSession)
    # Across loose groups, in larger buckets.
    left = apart_in_buckets(held.where(many).select("node", "key"), texts, loose)
    a, b = (left.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "loose", "wide"))) for side in "ab")
    differ = sum((F.bit_count(F.col("a_wide")[i].bitwiseXOR(F.col("b_wide")[i])) for i in range(WIDE)), F.lit(0))
    met = (a["key"] == b["key"]) & (F.col("a_loose") < F.col("b_loose")) & (differ <= int(64 * WIDE * ACROSS))
    across = kept(apart(a.join(b, met).select(*pair(F.col("a_node"), F.col("b_node"))).distinct(), named))
    if not across.isEmpty():
        named = kept(components(links.unionAll(tested(across)[1])))
    out = kept(own.select("doc_id", "text_key", "node").join(named, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component")))
    discard(own, texts, held, left, members, across, named, loose)
    swept(docs.sparkSession)
    return out


def firsts(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their group of near copies: by id, those without one last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    rows = near_copies(docs).groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    least = kept(rows.groupBy("component").agg(F.min(F.struct(order.alias("o"), "copies")).alias("m")).select("m.o.doc_id", "m.o.text_key", "m.copies"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    met = F.col("id").eqNullSafe(least["doc_id"]) & (F.col("key") == least["text_key"])
    once = own.join(least.where("copies = 1"), met, "left_semi")
    more = own.join(least.where("copies > 1"), met, "left_semi").dropDuplicates(["id", "key"])
    return once.unionAll(more).select("row.*")
