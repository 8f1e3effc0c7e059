"""Operator 13: hard negatives by a multiway hyperplane tree over embeddings.

Vectors are lifted by one component to a sphere (its square is the largest squared length less the vector's own), where a higher
inner product with an anchor is a smaller distance to it; a window of scores is an annulus.  A node of the tree has up to ``FAN`` split
points, chosen far apart from a bounded sample (``SAMPLE`` rows); every row goes to the child of the nearest one.  For each split point and each
child the smallest and largest distance of the child's rows to the point are stored, over all rows.  A child is left out of a
search if for some split point this range, seen from the anchor, misses the annulus.  What is left are leaves, in which scores are computed whole: exact whole
numbers in doubles (sums below 2**53).  The tree's depth grows with the table, so that a leaf has a few thousand rows; leaves that
hold more (copies of one vector) are cut into slices, and many anchors at one leaf into parts, so no task gets all of either.

An anchor first visits its own leaf for a floor of its fifth positive, then all leaves that can hold a better one; likewise for the negatives in
each positive's window.  Everything is a join of anchors to leaves; nothing but the tree comes to the driver.

Defined cases: rows with a null vec_id, label or vector, or a component that is null or not finite take no part; a shorter vector counts as ended by
zeros; rows that share a vec_id are rows of their own but neither positives nor negatives of an anchor of that id; an anchor without positives,
and a positive without negatives in its window, have no rows.  Only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, text_of

#: Children of a node, rows of a leaf that the depth aims at, rows the tree is fitted on, and the most rows and anchors that one group holds.
FAN = 8
LEAF = 4096
SAMPLE = 16384
SLICE = 4096
#: Every how many ids an anchor, positives and negatives by anchor, and the window in hundredths of the positive's score.
EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, with changed labels and components in whole 256ths, filled up to one length."""
    df = text_of(embeddings, "vec_id", "label", "embedding")
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = df.withColumn("x", x).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("x", lambda c: F.floor(F.lit(256.0) * c).cast("double"))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


class Tree:
    """Split points by node, children (a node's number, or -1 - leaf), and ranges of distances by node, split point and child."""

    def __init__(self, sample: np.ndarray, most: float, depth: int):
        self.most, self.points, self.children, self.ranges, self.leaves = most, [], [], [], 0
        self._grow(np.unique(sample, axis=0), depth)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        if depth == 0 or len(sample) < 2:
            return self._leaf()
        node = len(self.points)
        chosen = [0]  # then always the row whose nearest chosen one is farthest
        lifted = self.lift(sample)
        near = np.full(len(sample), np.inf)
        while len(chosen) < min(FAN, len(sample)):
            near = np.minimum(near, np.square(lifted - lifted[chosen[-1]]).sum(axis=1))
            chosen.append(int(near.argmax()))
        self.points.append(lifted[chosen])
        self.children.append([])
        self.ranges.append(None)
        own = self.distances(node, sample).argmin(axis=1)
        self.children[node] = [self._grow(sample[own == c], depth - 1) for c in range(len(chosen))]
        return node

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most - np.square(x).sum(axis=1), 0))])

    def distances(self, node: int, x: np.ndarray, lifted: bool = True) -> np.ndarray:
        """Distances of vectors (anchors are not lifted) to a node's split points."""
        points = self.points[node]
        square = self.most if lifted else np.square(x).sum(axis=1)[:, None]
        full = self.lift(x) @ points.T if lifted else x @ points[:, :-1].T
        return np.sqrt(np.maximum(square + self.most - 2 * full, 0))

    def walk(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; ``seen`` is called with a node, the distances of its rows, and their children's places."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            d = self.distances(node, x[rows])
            own = d.argmin(axis=1)
            if seen:
                seen(node, d, own)
            for c, child in enumerate(self.children[node]):
                part = rows[own == c]
                if child < 0:
                    leaf[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return leaf

    def reached(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that can hold a vector whose product with row's x is from low to high in one of its windows (columns)."""
        square = np.square(x).sum(axis=1)[:, None] + self.most
        slack = 1e-6 * np.sqrt(square + 1)
        inner, outer = np.sqrt(np.maximum(square - 2 * high, 0)) - slack, np.sqrt(np.maximum(square - 2 * low, 0)) + slack
        inner, outer = np.where(low > high, np.inf, inner), np.where(low > high, -np.inf, outer)
        rows, leaves = [], []
        todo = [(0, np.arange(len(x)))] if self.points else []
        if not todo:
            rows, leaves = [np.flatnonzero((low <= high).any(axis=1))], [np.zeros(int((low <= high).any(axis=1).sum()), np.int64)]
        while todo:
            node, some = todo.pop()
            d = self.distances(node, x[some], lifted=False)[:, :, None]
            least, most = self.ranges[node]
            nearest = np.maximum(np.maximum(d - most, least - d), 0)  # rows, split points, children
            farthest = d + most
            alive = np.zeros((len(some), len(self.children[node])), bool)
            for w in range(low.shape[1]):
                a, b = inner[some, w][:, None, None], outer[some, w][:, None, None]
                alive |= ((nearest <= b) & (farthest >= a)).all(axis=1)
            alive &= (least[0] <= most[0])[None, :]  # a child without rows
            for c, child in enumerate(self.children[node]):
                part = some[alive[:, c]]
                if child < 0:
                    rows.append(part)
                    leaves.append(np.full(len(part), -1 - child))
                elif len(part):
                    todo.append((child, part))
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def build_tree(rows: DataFrame, count: int, most: float, sample: int = SAMPLE) -> Tree:
    """The tree of ``rows`` (vec_id, v): split points from the ``sample`` rows of the smallest hashes, ranges from all rows."""
    depth = 0
    while FAN**depth * LEAF < count:
        depth += 1
    some = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(sample).collect()
    tree = Tree(np.array([r.v for r in some], float), most, depth)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        least = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        largest = [np.full((len(p), len(p)), -np.inf) for p in tree.points]

        def seen(node: int, d: np.ndarray, own: np.ndarray) -> None:
            for c in np.unique(own):
                part = d[own == c]
                least[node][:, c] = np.minimum(least[node][:, c], part.min(axis=0))
                largest[node][:, c] = np.maximum(largest[node][:, c], part.max(axis=0))

        for batch in batches:
            if len(batch):
                tree.walk(_matrix(batch.column(0)), seen)
        found = [(n, int(p), int(c), least[n][p, c], largest[n][p, c]) for n in range(len(tree.points)) for p, c in zip(*np.nonzero(largest[n] >= 0))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["node", "point", "child", "least", "most"])

    tree.ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points]
    ranges = rows.select("v").mapInArrow(measure, "node int, point int, child int, least double, most double").groupBy("node", "point", "child")
    for r in ranges.agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():  # at most FAN * FAN a node
        tree.ranges[r.node][0][r.point, r.child], tree.ranges[r.node][1][r.point, r.child] = r.least, r.most
    return tree


def _with_leaf(rows: DataFrame, shared: Broadcast) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.walk(_matrix(batch.column("v"))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(deal, "vec_id long, label long, v array<double>, leaf long")


_ASKED = "uid long, anchor_id long, label long, v array<double>, low array<double>, high array<double>"


def _routed(asked: DataFrame, shared: Broadcast) -> DataFrame:
    """Each anchor with its windows, once for each leaf that they reach."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            widths = np.diff(batch.column("low").offsets.to_numpy())
            for width in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                row, leaf = shared.value.reached(*(_matrix(part.column(c)) for c in ("v", "low", "high")))
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf, pa.int64())], [*part.schema.names, "leaf"])

    return asked.mapInArrow(route, f"{_ASKED}, leaf long")


def _searched(rows: DataFrame, asked: DataFrame, alike: bool, k: int) -> DataFrame:
    """(uid, window, vec_id, score): of each group of rows the best ``k`` of like (or unlike) label in each window of the anchors asked there.

    ``rows`` and ``asked`` have a leaf; both sides are cut into slices and parts of about ``SLICE``.
    """

    def cuts(df: DataFrame) -> DataFrame:
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).alias("n"))  # a row a leaf

    sizes = cuts(rows).withColumnRenamed("n", "slices").join(cuts(asked).withColumnRenamed("n", "parts"), "leaf")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(F.broadcast(sizes), "leaf").withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), F.col("slices")))
    left = left.select("leaf", "slice", numbers("parts").alias("part"), "vec_id", "label", "v")
    right = asked.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    right = right.select("leaf", numbers("slices").alias("slice"), "part", "uid", "anchor_id", "label", "v", "low", "high")

    def score(own: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(own) and len(anchors):
            own = own.sort_by("vec_id")
            ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
            products = _matrix(anchors.column("v")) @ _matrix(own.column("v")).T
            for s, a in zip(products, anchors.select(["uid", "anchor_id", "label", "low", "high"]).to_pylist()):
                fits = ((labels == a["label"]) == alike) & (ids != a["anchor_id"])
                for window, (low, high) in enumerate(zip(a["low"], a["high"])):
                    at = np.flatnonzero(fits & (s >= low) & (s <= high))
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    at = at[np.argsort(-s[at], kind="stable")][:k]
                    found += [(a["uid"], window, int(ids[i]), int(s[i])) for i in at]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["uid", "window", "vec_id", "score"])

    pairs = left.groupBy("leaf", "slice", "part").cogroup(right.groupBy("leaf", "slice", "part"))
    return pairs.applyInArrow(score, "uid long, window long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(rows: DataFrame, asked: DataFrame, shared: Broadcast, alike: bool, k: int, scratch: Scratch, name: str) -> DataFrame:
    """The best ``k`` of each window over all leaves: a visit to the anchor's own leaf raises the windows' lower ends first."""
    near = _ranked(_searched(rows, asked, alike, k), k).where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("floors"))
    own = asked.drop("leaf").join(near, "uid", "left")
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i.cast("long")), x)))
    routed = scratch.keep(_routed(own.withColumn("low", raised).select("uid", "anchor_id", "label", "v", "low", "high"), shared), f"{name}_routed")
    return scratch.keep(_ranked(_searched(rows, routed, alike, k), k), name)


def hard_negatives(embeddings: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors (every ``EVERY``-th id)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(usable(embeddings), "usable")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    width = max(width or 0, 1)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    tree = build_tree(rows, count, most or 0.0, sample) if count else Tree(np.zeros((0, width)), 0.0, 0)
    shared = spark.sparkContext.broadcast(tree)
    rows = scratch.keep(_with_leaf(rows, shared), "leaves")

    all_of_it = [F.array(F.lit(x).cast("double")).alias(n) for x, n in ((float("-inf"), "low"), (float("inf"), "high"))]
    anchors = rows.where(F.col("vec_id") % EVERY == 0).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").alias("anchor_id"), "label", "v", *all_of_it, "leaf")
    anchors = scratch.keep(anchors, "anchors")
    positives = _best(rows, anchors, shared, True, POSITIVES, scratch, "positives")

    ends = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), "vec_id", "score"))).alias("positives"))
    low, high = (lambda p: F.ceil(p.score * LOW / 100)), (lambda p: F.floor(p.score * HIGH / 100))
    asked = anchors.drop("low", "high").join(ends, "uid").withColumns({"low": F.transform("positives", lambda p: low(p).cast("double")), "high": F.transform("positives", lambda p: high(p).cast("double"))})
    asked = scratch.keep(asked.select("uid", "anchor_id", "label", "v", "low", "high", "leaf"), "asked")
    negatives = _best(rows, asked, shared, False, NEGATIVES, scratch, "negatives")

    named = positives.select("uid", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("uid", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["uid", "window"]).join(anchors.select("uid", "anchor_id"), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
