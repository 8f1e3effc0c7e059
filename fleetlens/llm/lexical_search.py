"""Operator 12: ranked lexical search over an index by strata of equal length.

The normaliser m of a score depends on a document's number of terms only, so documents of equal m form a stratum.  Documents are
dealt and sorted by ranges of (m, hash), so that a stratum of any size spreads over tasks, and cut into index blocks of at most
``BLOCK_DOCS`` documents of one m.  In a block, postings are grouped by (term, tf): all postings of a group have one impact,
which is computed once.  A term's largest tf in a block gives its largest impact there, and the sum of these over an item's terms is the block's bound for the item.

A search visits blocks in the order of their bounds: first the ``FIRST`` blocks of the largest bounds of each item (over all blocks), whose
tenth score is a floor; then each task its blocks from the largest bound down, and a block only for items whose bound reaches the
floor there (at the floor itself too, because of ties), which rises as the task finds better documents.  What tasks found is merged by rank.  Results are exact.

Items go to tasks in passes of ``PASS_CHARS`` characters; a pass indexes the terms of its items.  Terms are compared as 64-bit hashes.

Defined cases: null text has no term; documents without a term count nowhere and are never found; an item without terms, or whose terms no document
has, has no rows; repeated rows are documents (or items) of their own; of equal scores a null doc_id comes last.  Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, text_of
from .wordhash import PUNCTUATION, Words, text_chunks

#: Documents of a block, characters of the items of a pass, and blocks that each item visits first.
BLOCK_DOCS = 2048
PASS_CHARS = 2_000_000
FIRST = 3
#: Fixed values of the score: free and length part of the normaliser (of 100), scale of a tf's share, and its factors.
FREE, BY_LENGTH = 10, 90
SCALE, PER_TF, PER_M = 1_000_000_000, 1000, 8
_INDEX = "block long, m long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, at array<int>"


def term_weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


class Pass:
    """Some items and their terms: ``known`` are the terms' hashes in order, ``terms[starts[k]:starts[k + 1]]`` item k's terms as places in it."""

    def __init__(self, rows: list[tuple]):
        self.items = [r[0] for r in rows]
        texts = pa.array([r[1] for r in rows], pa.string())
        each: list[np.ndarray] = []
        for _, data, offsets in text_chunks(texts):
            words = Words(data, offsets, separators=PUNCTUATION)
            each += [np.unique(words.hash[a:b]) for a, b in zip(words.row[:-1], words.row[1:])]
        self.known = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        self.terms = np.searchsorted(self.known, np.concatenate(each)) if each else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *map(len, each)])

    def bounds(self, largest: np.ndarray) -> np.ndarray:
        """For each item the sum of ``largest`` over its terms."""
        total = np.concatenate([[0], np.cumsum(largest[self.terms])])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def _passes(items: DataFrame) -> Iterator[Pass]:
    rows = text_of(items, "item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = -(-total // PASS_CHARS)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(passes, 1)))
    for k in range(passes):
        yield Pass([(r.item_id, r.text) for r in rows.where(number == k).collect()])


def _forward(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: their number of terms, and which of the pass's terms occur how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, separators=PUNCTUATION)
                n = np.diff(words.row)
                place = np.searchsorted(known, words.hash)
                found = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == words.hash)
                row = np.searchsorted(words.row, found, side="right") - 1
                pairs, tfs = np.unique(row * len(known) + place[found], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(n) + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % len(known), tfs)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def _index(forward: DataFrame, documents: int, terms: int) -> DataFrame:
    """Blocks of documents of one m: postings by term and tf, ``at[ends[g - 1]:ends[g]]`` the places in ``docs`` of group g."""
    m = F.lit(FREE) + F.call_function("div", F.col("n").cast("decimal(38,0)") * F.lit(BY_LENGTH * documents), F.lit(terms))
    rows = forward.where(F.size("terms") > 0).select(m.cast("long").alias("m"), "doc_id", "terms", "tfs")
    rows = rows.repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            ms = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(ms, prepend=ms[0] - 1, append=ms[-1] + 1)).tolist() if len(ms) else []
            pieces = [(a, min(a + BLOCK_DOCS, z)) for s, z in zip(edges[:-1], edges[1:]) for a in range(s, z, BLOCK_DOCS)]
            out: list[list] = [[] for _ in range(7)]
            for a, z in pieces:
                part = batch.slice(a, z - a)
                lists = part.column(2)
                own = np.repeat(np.arange(z - a), lists.value_lengths().to_numpy())
                t, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                order = np.lexsort((own, tf, t))
                t, tf, own = t[order], tf[order], own[order]
                heads = np.flatnonzero(np.diff(t, prepend=-1) | np.diff(tf, prepend=-1))
                row = (block, int(ms[a]), part.column(1).to_pylist(), t[heads], tf[heads], np.append(heads[1:], len(t)), own)
                for column, value in zip(out, row):
                    column.append(value)
                block += 1
            if pieces:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4)
                names = ["block", "m", "docs", "terms", "tfs", "ends", "at"]
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.int32) if isinstance(v, np.ndarray) else v for v in c], k) for c, k in zip(out, kinds)], names)

    return rows.mapInArrow(cut, _INDEX)


class _Block:
    """An index block (a row of a batch) with its impacts, each computed once by term and tf.  Document ids and postings are read when the block is visited."""

    def __init__(self, batch: pa.RecordBatch, row: int, weights: np.ndarray):
        self._batch, self._row = batch, row
        self.number = batch.column("block")[row].as_py()
        self.ends, self.terms, tf = (self._list(c).astype(np.int64) for c in ("ends", "terms", "tfs"))
        self.impacts = weights[self.terms] * (SCALE * tf // (PER_TF * tf + PER_M * batch.column("m")[row].as_py()))
        last = np.flatnonzero(np.diff(self.terms, append=-1))  # a term's largest tf comes last
        self.largest = np.zeros(len(weights), np.int64)
        self.largest[self.terms[last]] = self.impacts[last]

    def _list(self, column: str) -> np.ndarray:
        return self._batch.column(column)[self._row].values.to_numpy(zero_copy_only=False)

    def visit(self) -> _Block:
        """The block, ready for ``scores``."""
        self.docs = self._batch.column("docs")[self._row].values
        self._at = self._list("at").astype(np.int64)
        self._of = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        return self

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """Scores of the block's documents for the terms marked in ``wanted``."""
        hit = np.flatnonzero(wanted[self.terms][self._of])
        total = np.zeros(len(self.docs), np.int64)
        np.add.at(total, self._at[hit], self.impacts[self._of[hit]])
        return total


class _Best:
    """The best documents of an item so far; ``floor`` is what a score has to reach."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, max(floor, 1), []

    def add(self, scores: np.ndarray, docs: pa.Array) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if len(at) > self.k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        rows = self.rows + [(-int(s), d is None, d or 0) for s, d in zip(scores[at], docs.take(pa.array(at)).to_pylist())]
        self.rows = sorted(rows)[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -self.rows[-1][0])


def _visited(index: DataFrame, shared, k: int, only: bool) -> DataFrame:
    """(item, score, doc_id): the best ``k`` of each task.  With ``only`` each item visits the blocks chosen for it; else those whose bound reaches its floor."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, chosen, floors = shared.value
        best: dict[int, _Best] = {}
        for batch in batches:
            numbers = batch.column("block").to_pylist()
            tops = {n: int(items.bounds(_Block(batch, n, weights).largest).max(initial=0)) for n, b in enumerate(numbers) if not only or b in chosen}
            for n in sorted(tops, key=lambda n: -tops[n]):
                block = _Block(batch, n, weights)
                bounds = items.bounds(block.largest)
                asked = chosen[block.number] if only else np.flatnonzero(bounds >= floors).tolist()
                for item in asked:
                    own = best.setdefault(item, _Best(k, int(floors[item])))
                    if bounds[item] >= own.floor:
                        wanted = np.zeros(len(weights), bool)
                        wanted[items.terms[items.starts[item] : items.starts[item + 1]]] = True
                        own.add((block if hasattr(block, "docs") else block.visit()).scores(wanted), block.docs)
        rows = [(item, -s, None if null else d) for item, b in best.items() for s, null, d in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "score", "doc_id"])

    return index.mapInArrow(visit, "item int, score long, doc_id long")


def _first_blocks(index: DataFrame, shared) -> dict[int, list[int]]:
    """By block the items that visit it first: those of which its bound is among the ``FIRST`` largest."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value[:2]
        top, at = np.zeros((FIRST, len(items.items)), np.int64), np.zeros((FIRST, len(items.items)), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                block = _Block(batch, row, weights)
                bound, number = items.bounds(block.largest), np.full(len(items.items), block.number)
                for k in range(FIRST):
                    up = bound > top[k]
                    top[k], bound = np.where(up, bound, top[k]), np.where(up, top[k], bound)
                    at[k], number = np.where(up, number, at[k]), np.where(up, at[k], number)
        place, item = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(top[place, item]), pa.array(at[place, item])], ["item", "bound", "block"])

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    chosen: dict[int, list[int]] = {}
    for r in index.mapInArrow(largest, "item int, bound long, block long").withColumn("rank", rank).where(F.col("rank") <= FIRST).collect():
        chosen.setdefault(r.block, []).append(r.item)
    return chosen


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(docs: DataFrame, items: Pass, k: int, scratch: Scratch) -> DataFrame | None:
    spark = docs.sparkSession
    if not len(items.known):
        return None
    send = spark.sparkContext.broadcast
    forward = scratch.keep(_forward(docs, send(items)), "forward")
    documents, terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    having = np.zeros(len(items.known), np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        having[r.term] = r["count"]
    weights = np.array([term_weight(documents, n) for n in having.tolist()], np.int64)
    index = scratch.keep(_index(forward, documents, terms), "index")
    floors = np.ones(len(items.items), np.int64)
    chosen = _first_blocks(index, send((items, weights)))
    first = _ranked(_visited(index, send((items, weights, chosen, floors)), k, True), k)
    for r in first.where(F.col("rank") == k).collect():
        floors[r.item] = r.score
    found = scratch.keep(_ranked(_visited(index, send((items, weights, {}, floors)), k, False), k), "found")
    scratch.drop(forward, index)
    names = spark.createDataFrame(list(enumerate(items.items)), "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each row of ``items``."""
    scratch = Scratch(docs.sparkSession)
    texts = text_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = [x for p in _passes(items.withColumn("item_id", F.col("item_id").cast("long"))) if (x := _searched(texts, p, k, scratch)) is not None]
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(lambda a, b: a.unionByName(b), found) if found else none
