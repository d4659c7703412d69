"""Hard negatives by inner product, through a vantage-point tree over norm-augmented vectors.

A further coordinate brings every row's vector to the length of the longest; an anchor has 0 there. The
squared distance of an anchor and a row is then a constant of the anchor less twice their product, so
that a window of scores is an annulus around the anchor. A vantage-point tree, chosen from a bounded
sample, deals all rows out to leaves; each leaf has, for every vantage point above it, the least and the
largest distance of its rows. An anchor's leaves are those that its annulus may touch, nearest first.
They are met in waves, each four times as wide as the one before; after a wave, an anchor goes on only
to leaves that may hold something better than the k-th best it has. Which tree it is changes the work
and never the result. Vectors without any structure touch most leaves: every anchor then meets most rows.

Leaves are cut into blocks, and anchors into chunks, of bounded numbers of rows; a task meets a block and
a chunk. Of equal vectors with one label only those of the smallest ids are candidates, as no others can
be among anyone's first: a vector that very many rows share is met once.

Rows whose id, label or vector is null, whose vector is empty or holds a null or a non-finite component,
or is of another length than most (of equally many, the greater), take no part. Rows of one id are one:
the smallest in the order of vector and label. Ties go to the smaller id. An empty table gives an empty
result. Squared lengths of 2 ** 53 and more, beyond which a double doesn't hold a score, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, kept

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative's score is between these percents of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a chunk, leaves of the tree at most, and rows of the sample that it is chosen from (in the mean).
BLOCK, CHUNK, LEAVES, SAMPLE = 4096, 4096, 4096, 16384
#: Each wave of leaves is so many times as wide as the one before.
WIDER = 4
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NONE = 1 << 62


def prepared(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x, n2) of the rows that take part: whole numbers and their squared length."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("c") > 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), c.alias("c")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    widths = own.groupBy(F.size("c").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    x = F.transform("c", lambda v: F.floor(v * scale).cast("long"))
    own = own.where(F.size("c") == (widths[0]["width"] if widths else 0)).select("vec_id", "label", x.alias("x"))
    own = own.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return own.groupBy("vec_id").agg(F.min(F.struct("x", "label", "n2")).alias("r")).select("vec_id", "r.label", "r.x", "r.n2")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Tree:
    """A complete binary tree of vantage points: rows within a node's radius go left."""

    def __init__(self, sample: np.ndarray, longest2: float, depth: int) -> None:
        self.depth, self.longest2 = depth, longest2
        nodes = (1 << depth) - 1
        self.points = np.zeros((nodes, sample.shape[1] + 1))
        self.radius = np.zeros(nodes)
        own = {0: self.augmented(sample)}
        for node in range(nodes):
            rows = own.pop(node)
            if len(rows):
                self.points[node] = rows[np.linalg.norm(rows - rows.mean(axis=0), axis=1).argmax()]
            away = np.linalg.norm(rows - self.points[node], axis=1)
            self.radius[node] = np.median(away) if len(rows) else 0.0
            own[2 * node + 1], own[2 * node + 2] = rows[away <= self.radius[node]], rows[away > self.radius[node]]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.clip(self.longest2 - (x * x).sum(axis=1), 0, None))))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances to the vantage points above it) of rows."""
        own, node = self.augmented(x), np.zeros(len(x), dtype=np.int64)
        away = np.zeros((len(x), self.depth))
        for level in range(self.depth):
            away[:, level] = np.linalg.norm(own - self.points[node], axis=1)
            node = 2 * node + 1 + (away[:, level] > self.radius[node])
        return node - ((1 << self.depth) - 1), away

    def scores(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) scores that each anchor (row) may have with the rows of each leaf (column).

        near and far hold the bounds of distances by leaf and level. Both are wide enough for rounding.
        """
        q2 = (q * q).sum(axis=1)[:, None]
        whole = q2 + self.longest2
        least = np.zeros((len(q), len(near)))
        most = np.full((len(q), len(near)), np.inf)
        if self.depth:
            away = np.sqrt(np.clip(q2 + (self.points**2).sum(axis=1) - 2 * q @ self.points[:, :-1].T, 0, None))
            leaf = np.arange(len(near)) + (1 << self.depth) - 1
            for level in range(self.depth - 1, -1, -1):
                leaf = (leaf - 1) // 2
                d = away[:, leaf]
                least = np.maximum(least, np.maximum(near[:, level] - d, d - far[:, level]))
                most = np.minimum(most, d + far[:, level])
        slack = 1e-6 * whole + 1e-3
        return (whole - most**2) / 2 - slack, (whole - least**2) / 2 + slack


def runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(leaf, first chunk, chunks): leaves in turn share a chunk of size rows; a leaf of more rows has several of its own."""
    out, at, held = [], 0, 0
    for leaf, n in sorted(counts.items()):
        if held and held + n > size:
            at, held = at + 1, 0
        parts = -(-n // size)
        out.append((leaf, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


class Index:
    """All candidates dealt out to blocks, and what routes anchors to them."""

    def __init__(self, rows: DataFrame, kept_ids: int, block: int = BLOCK, leaves: int = LEAVES, sample: int = SAMPLE) -> None:
        spark = rows.sparkSession
        order = F.row_number().over(Window.partitionBy("x", "label").orderBy("vec_id"))
        self.rows = kept(rows.withColumn("order", order).where(F.col("order") <= kept_ids).drop("order"))
        n, longest2 = self.rows.agg(F.count("*"), F.max("n2")).first()
        if longest2 is not None and longest2 >= 2.0**53:
            raise ValueError("scores of these vectors are beyond what a double holds exactly")
        self.empty = not n
        if self.empty:
            return
        depth = min(max(0, (-(-n // block) - 1).bit_length()), leaves.bit_length() - 1)
        chosen = self.rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))) if depth else self.rows.limit(1)
        tree = self.tree = Tree(_matrix(chosen.select("x").toArrow().column(0).combine_chunks()), longest2, depth)
        self.x_kind = dict(rows.dtypes)["x"]
        placed = kept(self.placed(self.rows))
        bounds = placed.groupBy("leaf").agg(F.count("*").alias("n"), *(f(F.col("away")[i]).alias(f"{k}{i}") for i in range(depth) for k, f in (("near", F.min), ("far", F.max)))).collect()
        #: By leaf: its blocks and the bounds of its rows' distances. As many numbers as leaves and levels.
        bounds.sort(key=lambda r: r["leaf"])
        self.leaf = np.array([r["leaf"] for r in bounds])
        self.near, self.far = (np.full((1 << depth, depth), v) for v in (np.inf, -np.inf))
        for r in bounds:
            self.near[r["leaf"]], self.far[r["leaf"]] = [r[f"near{i}"] for i in range(depth)], [r[f"far{i}"] for i in range(depth)]
        parts = [-(-r["n"] // block) for r in bounds]
        self.first = np.concatenate(([0], np.cumsum(parts)))
        table = spark.createDataFrame([(int(r["leaf"]), int(a), p) for r, a, p in zip(bounds, self.first, parts)], "leaf int, first int, parts int")
        self.blocks = kept(placed.join(F.broadcast(table), "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"), "vec_id", "label", "x"))
        discard(placed)

    def placed(self, rows: DataFrame) -> DataFrame:
        """(vec_id, label, x, leaf, away) of rows."""
        tree = self.tree

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    leaf, away = tree.leaves(_matrix(b.column(2)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * tree.depth, pa.int32()), pa.array(away.ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(leaf.astype(np.int32)), lists], names=["vec_id", "label", "x", "leaf", "away"])

        return rows.select("vec_id", "label", "x").mapInArrow(place, f"vec_id long, label long, x {self.x_kind}, leaf int, away array<double>")

    def chunked(self, anchors: DataFrame, size: int = CHUNK) -> DataFrame:
        """(anchor_id, label, x, chunk) of anchors; those of a chunk are of neighbouring leaves."""
        own = kept(self.placed(anchors).drop("away"))
        counts = {r["leaf"]: r["count"] for r in own.groupBy("leaf").count().collect()}
        table = anchors.sparkSession.createDataFrame(runs(counts, size), "leaf int, first int, parts int")
        out = kept(own.join(F.broadcast(table), "leaf").select(F.col("vec_id").alias("anchor_id"), "label", "x", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("chunk")))
        discard(own)
        return out

    def searched(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, place, vec_id, score): the k best rows within each window of each anchor, of its own label or of others.

        asked: (anchor_id, label, x, chunk, lows, highs), the two being the ends of as many windows for each anchor.
        """
        spark = asked.sparkSession
        tree, near, far, leaf, first = self.tree, self.near, self.far, self.leaf, self.first
        sent_as = f"anchor_id long, label long, x {self.x_kind}, lows array<long>, highs array<long>, chunk int, block int"

        def route(taken: int, width: int):
            """Anchors to the blocks of their nearest leaves, from the place `taken` on."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(0, batch.num_rows, 256):
                        b = batch.slice(i, 256)
                        least, most = tree.scores(_matrix(b.column(2)), near, far)
                        least, most = least[:, leaf], most[:, leaf]
                        low, high, bound = _matrix(b.column(3)).min(axis=1), _matrix(b.column(4)).max(axis=1), _matrix(b.column(6)).min(axis=1)
                        touched = (most >= low[:, None]) & (least <= high[:, None])
                        order = np.argsort(np.where(touched, -most, np.inf), axis=1, kind="stable")[:, taken : taken + width]
                        goes = np.take_along_axis(touched & (most >= bound[:, None]), order, axis=1)
                        at, column = np.nonzero(goes)
                        chosen = order[at, column]
                        blocks = first[chosen + 1] - first[chosen]
                        each = np.repeat(np.arange(len(at)), blocks)
                        block = first[chosen][each] + np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        some = b.take(pa.array(at[each]))
                        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (0, 1, 2)), some.column(6), some.column(4), some.column(5), pa.array(block.astype(np.int32))], names=["anchor_id", "label", "x", "lows", "highs", "chunk", "block"])

            return run

        def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            anchors, rows = anchors.combine_chunks(), rows.combine_chunks().sort_by("vec_id")
            found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            if anchors.num_rows and rows.num_rows:
                plain = lambda t, c: t.column(c).to_numpy().astype(np.int64)
                whole = lambda t, c: _matrix(t.column(c).combine_chunks())
                ids, labels, x = plain(rows, "vec_id"), plain(rows, "label"), whole(rows, "x")
                own, kinds, q = plain(anchors, "anchor_id"), plain(anchors, "label"), whole(anchors, "x")
                lows, highs = (np.array(anchors.column(c).to_pylist(), dtype=np.int64) for c in ("lows", "highs"))
                for i in range(0, len(own), 256):
                    scores = (q[i : i + 256] @ x.T).astype(np.int64)
                    fits = (labels == kinds[i : i + 256, None]) == same
                    fits &= ids != own[i : i + 256, None]
                    for j, (line, fit) in enumerate(zip(scores, fits)):
                        for place, (low, high) in enumerate(zip(lows[i + j], highs[i + j])):
                            at = np.flatnonzero(fit & (line >= low) & (line <= high))
                            if len(at) > k:
                                least = np.partition(line[at], len(at) - k)[len(at) - k]
                                at = at[line[at] >= least]
                            at = at[np.argsort(-line[at], kind="stable")[:k]]
                            if len(at):
                                found.append((own[i + j], place, ids[at], line[at]))
            flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            sizes = [len(f[2]) for f in found]
            repeated = lambda c, kind: np.repeat(np.array([f[c] for f in found], kind), sizes)
            return pa.table({"anchor_id": repeated(0, np.int64), "place": repeated(1, np.int32), "vec_id": flat([f[2] for f in found], np.int64), "score": flat([f[3] for f in found], np.int64)})

        best = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
        found = spark.createDataFrame([], "anchor_id long, place int, vec_id long, score long")
        asked = asked.select("anchor_id", "label", "x", "lows", "highs", "chunk")
        taken, width = 0, 1
        while taken < len(leaf):
            # A window with k rows asks for no less than the least of them; of equal scores the smaller id still counts.
            full = found.groupBy("anchor_id", "place").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            by = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("full"))
            bounds = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("full", i), low)))
            now = asked.join(by, "anchor_id", "left").select(*asked.columns, bounds.alias("bounds")) if taken else asked.withColumn("bounds", F.col("lows"))
            routed = kept(now.mapInArrow(route(taken, width), sent_as))
            if routed.isEmpty():
                discard(routed)
                break
            pairs = routed.select("block", F.col("chunk").alias("row_chunk")).distinct()
            rows = self.blocks.join(pairs, "block").select(F.col("block").alias("row_block"), "row_chunk", "vec_id", "label", "x")
            new = routed.groupBy("block", "chunk").cogroup(rows.groupBy("row_block", "row_chunk")).applyInArrow(meet, found.schema)
            before, found = found, kept(found.unionAll(new).withColumn("best", best).where(F.col("best") <= k).drop("best"))
            discard(before, routed)
            taken, width = taken + width, width * WIDER
        return found


def mined(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, **sizes: int) -> DataFrame:
    """Of each anchor (rows for which is_anchor holds) and each of its first positives, the first negatives; of SCHEMA.

    Positives are the other rows of the anchor's label, by score. Negatives are rows of other labels whose
    scores are from low to high percent of the positive's: none, if that is below zero. sizes: see Index.
    """
    spark = vectors.sparkSession
    rows = kept(prepared(vectors, label, scale))
    index = Index(rows, max(positives + 1, negatives), **sizes)
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    if index.empty or anchors.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    asked = index.chunked(anchors)
    near = index.searched(asked.withColumns({"lows": F.array(F.lit(-_NONE)), "highs": F.array(F.lit(_NONE))}), positives, True)
    place = (F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")) - 1).cast("int")
    near = kept(near.select("anchor_id", place.alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # The whole numbers at and above low percent, and at and below high percent, of the positive's score.
    ends = F.struct("place", F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100").alias("l"), F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100").alias("h"))
    by = near.select("anchor_id", ends.alias("e")).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("e.place", F.col("e")))).alias("ends"))
    each = [F.try_element_at("ends", F.lit(i)) for i in range(positives)]
    lows = F.array(*(F.coalesce(e["l"], F.lit(_NONE)) for e in each))
    highs = F.array(*(F.coalesce(e["h"], F.lit(-_NONE)) for e in each))
    far = index.searched(asked.join(by, "anchor_id").withColumns({"lows": lows, "highs": highs}), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    far = far.select("anchor_id", "place", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
