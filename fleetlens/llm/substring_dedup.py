"""Operator 2: repeated spans of sentences.

A sentence ends at a line end, or after . ! or ? before white space; one of over ``LONG`` words is
also cut by content: of every ``NEAR`` neighbouring places between two of its words, the one where the hash of the two is least
(all of them, if several are).  So pieces are of at most ``NEAR`` words, and a place is a cut or not by the few words around it:
over ``LONG`` words of a sentence that stand elsewhere too fall into the same pieces there, but for ``NEAR`` words at
either end, whatever comes before and after.  A repeated passage of 51 words therefore always holds a whole run, wherever
it starts and ends.  Of it stay at most ``NEAR`` words at its start and less than two times that at its end; or, where short
sentences stand there, the part of one, and at the end a whole one that no run ends with.  A run starts at each sentence and takes sentences until it has
``SENTENCES`` of them and ``WORDS`` words.  Runs are compared by two 64-bit hashes of their words (case and white
space do not count) over the whole corpus.  The first occurrence of a run is that of the smallest
(doc_id, sentence); every sentence that another occurrence covers is removed.

Plan: runs are counted by their first hash, combined in the tasks; only hashes of several occurrences go on. The
texts are read again, runs that are surely single (a filter of fixed size) stay in their task, the others
are joined to the repeated ones and judged by both hashes; what is to be removed is grouped by document and
joined to the texts.  No group of equal runs is gathered: the first is a minimum, the rest a join.

Defined cases: null and empty texts, and rows with a null doc_id, stay as they are and take no part; rows that repeat a doc_id
count as one document, in which equal runs at the same sentence are the same occurrence.  A text that loses all
its sentences becomes empty.  Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import membership
from .shared import Scratch, fresh, with_fields
from .wordhash import _SPACE, Words, mix, text_chunks

SENTENCES = 2
WORDS = 28
LONG = 11
NEAR = 5
_PAIR = np.uint64(0xA24BAED4963EE407)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_OTHER = np.uint64(0x8BB84B93962EACC9)
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _inner_cuts(words: Words, cuts: np.ndarray) -> np.ndarray:
    """For each word but the last, whether its sentence (between two of ``cuts``) is long and cut after it."""
    of_word = np.searchsorted(cuts, words.start, side="right") - 1
    long = np.bincount(of_word, minlength=len(cuts))[of_word] > LONG
    inner = long[:-1] & (of_word[1:] == of_word[:-1])
    places = len(inner) - NEAR + 1
    chosen = np.zeros(len(inner), dtype=bool)
    if places < 1:
        return chosen
    pair = mix(words.hash[:-1] * _PAIR + words.hash[1:])
    least, whole = pair[:places].copy(), inner[:places].copy()
    for k in range(1, NEAR):
        np.minimum(least, pair[k : k + places], out=least)
        whole &= inner[k : k + places]
    for k in range(NEAR):
        chosen[k : k + places] |= whole & (pair[k : k + places] == least)
    return chosen


class Sentences:
    """Sentences of a run of texts: ``start`` and ``end`` bytes, per row the slice ``row[i]:row[i+1]``, and ``run`` hashes with ``length``.

    A sentence where no run starts has length 0.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sentences: int, least: int):
        n = len(data)
        words = Words(data, offsets)
        space = _SPACE[data]
        ends = np.zeros(n + 1, dtype=bool)
        ends[offsets] = True
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        closes = (data == 10) | (_STOP[data] & after)
        ends[1:] |= closes
        cuts = np.flatnonzero(ends)
        cuts = np.union1d(cuts, words.end[:-1][_inner_cuts(words, cuts)])
        cuts = cuts[cuts <= n]
        self.start, self.end = cuts[:-1], cuts[1:]
        self.row = np.searchsorted(self.start, offsets)
        first = np.searchsorted(words.start, cuts)  # words before each cut
        k = len(self.start)
        # a run goes on until it has enough sentences with words, and enough words
        has = np.diff(first) > 0
        with_words = np.concatenate([[0], np.cumsum(has)])
        at = np.arange(k)
        by_words = np.searchsorted(first, first[:-1] + least, side="left")
        by_sentences = np.searchsorted(with_words, with_words[:-1] + sentences, side="left")
        stop = np.maximum(by_words, by_sentences)
        last = np.repeat(self.row[1:], np.diff(self.row)) if k else at
        fits = has & (stop <= last)
        self.length = np.where(fits, stop - at, 0)
        powers = np.full(len(words.hash) + 1, _BASE, dtype=np.uint64)
        back = np.full(len(words.hash) + 1, _BACK, dtype=np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * powers[:-1], dtype=np.uint64)])
        a, b = first[:-1], first[np.minimum(stop, k)]
        value = (total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)
        self.run = mix(value).view(np.int64)
        self._words, self._powers, self._back, self._from, self._to = words.hash, powers, back, a, b

    def check(self, at: np.ndarray) -> np.ndarray:
        """A second hash of the words of the runs at ``at``, by another mixture of theirs."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self._words ^ _OTHER) * self._powers[:-1], dtype=np.uint64)])
        a, b = self._from[at], self._to[at]
        return mix((total[b] - total[a]) * self._back[a]).view(np.int64)


def _each(column: pa.Array, sentences: int, least: int) -> Iterator[tuple[int, np.ndarray, Sentences]]:
    for first, data, offsets in text_chunks(column):
        yield first, data, Sentences(data, offsets, sentences, least)


def _runs(docs: DataFrame, sentences: int, least: int, among=None) -> DataFrame:
    """(run, check, doc_id, sentence): where each run starts; only runs that may be in the filter, if there is one, and ``check`` (the second hash) only then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, _, s in _each(batch.column("text"), sentences, least):
                per_row = np.diff(s.row)
                owner = np.repeat(np.arange(len(per_row)), per_row)
                keep = s.length > 0
                if among is not None:
                    keep &= membership.maybe(among.value, s.run)
                at = np.flatnonzero(keep)
                sentence = at - s.row[owner[at]]
                columns = {"run": s.run[at], "doc_id": ids[first + owner[at]], "sentence": sentence.astype(np.int32)}
                if among is not None:
                    columns["check"] = s.check(at)
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    return texts.mapInArrow(run, "run long, doc_id long, sentence int" + (", check long" if among is not None else ""))


def substring_dedup(docs: DataFrame, sentences: int = SENTENCES, least: int = WORDS) -> DataFrame:
    """``docs`` with its texts deduplicated (same columns), and n_sentences, n_removed (longs).

    See the module for the rule, the plan and the defined cases.
    """
    scratch = Scratch(docs.sparkSession)
    place = F.struct("doc_id", "sentence")
    bounds = (F.min(place).alias("first"), F.max(place).alias("last"))
    often = scratch.keep(_runs(docs, sentences, least).groupBy("run").agg(*bounds).where("first <> last").select("run"), "often")
    among = membership.build(often, "run")
    found = scratch.keep(_runs(docs, sentences, least, among).join(often, "run"), "found")
    repeated = scratch.keep(found.groupBy("run", "check").agg(*bounds).where("first <> last").select("run", "check", "first"), "repeated")  # written, so that the join can split a run of many places
    others = scratch.keep(found.join(repeated, ["run", "check"]).where(place != F.col("first")).select("doc_id", "sentence", "run"), "others")
    scratch.drop_but(others)
    gone = others.groupBy("doc_id").agg(F.collect_set(F.struct("sentence", "run")).alias("gone"))

    ids, mine, total, removed = (fresh(docs, x) for x in ("id", "gone", "n_sentences", "n_removed"))
    joined = docs.withColumn(ids, F.col("doc_id").cast("long")).join(gone.withColumnsRenamed({"doc_id": ids, "gone": mine}), ids, "left").drop(ids)
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, texts = batch.column(mine).to_pylist(), batch.column("text")
            new: list = [None] * len(batch)
            n_all, n_gone = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for first, data, s in _each(texts, sentences, least):
                for i in range(len(s.row) - 1):
                    a, b, k = int(s.row[i]), int(s.row[i + 1]), first + i
                    n_all[k] = b - a
                    if not gone[k]:
                        continue
                    drop = np.zeros(b - a, dtype=bool)
                    for x in gone[k]:
                        at = x["sentence"]
                        if at < b - a and s.length[a + at] and int(s.run[a + at]) == x["run"]:
                            drop[at : at + int(s.length[a + at])] = True
                    n_gone[k] = drop.sum()
                    if n_gone[k]:
                        new[k] = b"".join(data[s.start[j] : s.end[j]].tobytes() for j in a + np.flatnonzero(~drop)).decode("utf-8", "replace")
            changed = pa.array(n_gone > 0)
            text = pc.if_else(changed, pa.array(new, pa.string()), texts)
            columns = [text if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_all), pa.array(n_gone)], [*names, total, removed])

    return joined.mapInArrow(rewrite, with_fields(docs, f"`{total}` long, `{removed}` long"))
