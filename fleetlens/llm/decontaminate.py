"""Operator 6: benchmark items in documents, within an error budget.

Texts are compared in lower case with runs of white space as one space.  An item of m
characters may differ by k = floor(``RATE`` m) edits.  It is split into k + 1 pieces; by the pigeonhole principle a
passage within k edits holds one of them unchanged.  An automaton over all pieces reads each
text once; a piece hit fixes where the item would lie, and Myers' bit-parallel algorithm gives
the least distance of the item to any passage there.  Stretches of text that hits of one item point to are joined where
they overlap, so each place of a text is compared once with an item, however often a piece repeats.

The benchmark is a set of queries against all documents: it goes to tasks in blocks
of ``BLOCK_CHARS`` characters, each a pass of its own, so a task holds one block at a time, whatever the benchmark's size.

Items of fewer than ``LEAST_CHARS`` characters are searched by the same automaton whole, without errors, and only between word bounds
(a letter, mark, digit or _ next to another is none; letters of scripts written without spaces always are).

Defined cases: items with null, or without characters other than white space, match nothing; null and empty texts match nothing; items of equal text match alike; rows with null or repeated doc_id stay separate rows; very long texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, with_fields

RATE = 0.08
LEAST_CHARS = 40
BLOCK_CHARS = 8_000_000
_HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first", pa.int64()), ("end", pa.int64())])
_HITS = "array<struct<item_id:long,distance:int,first:long,end:long>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 parts of about equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _joins(c: str) -> bool:
    """Whether a word goes on over this character: not for scripts written without spaces."""
    if c == "_":
        return True
    unspaced = unicodedata.east_asian_width(c) in "WF" or "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff"
    return unicodedata.category(c)[0] in "LMN" and not unspaced


def bounded(text: str, first: int, end: int) -> bool:
    """Whether ``text[first:end]`` starts and ends at word bounds."""
    return not (first and _joins(text[first - 1]) and _joins(text[first])) and not (end < len(text) and _joins(text[end - 1]) and _joins(text[end]))


class Pattern:
    """An item, ready for Myers' algorithm: one machine-independent integer holds a column of the distance table."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the nearest passage of ``text`` within ``most`` edits; of equal ones the first.  ``anchored``: that begins where the text does."""
        plus, minus, now, best = self.full, 0, self.size, None
        full, top, masks = self.full, self.top, self.masks
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = eq | minus
            zero = ((((x & plus) + plus) ^ plus) | x) & full
            up = minus | (full & ~(zero | plus))
            down = plus & zero
            if up & top:
                now += 1
            elif down & top:
                now -= 1
            up = (up << 1 | anchored) & full
            down = down << 1 & full
            plus = down | (full & ~(zero | up))
            minus = up & zero
            if now <= most:
                best, most = (now, at), now - 1
                if most < 0:
                    break
        return best


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = int(rate * len(text)) if len(text) >= LEAST_CHARS else 0
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, Pattern(text), budget))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def _stretches(self, text: str) -> tuple[dict[int, list[list[int]]], dict[int, int]]:
        """By item the stretches of the text where it may lie, joined as they come, and the ends of short items found."""
        where: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                _, item, _, budget = self.items[number]
                begin = last + 1 - size - offset  # where the item starts if nothing before the piece was added or lost
                if len(item) < LEAST_CHARS:  # the piece is the item
                    if number not in short and bounded(text, begin, last + 1):
                        short[number] = last + 1
                    continue
                low, high = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                found = where.setdefault(number, [])
                if found and found[-1][0] <= high and low <= found[-1][1]:
                    found[-1][0], found[-1][1] = min(found[-1][0], low), max(found[-1][1], high)
                else:
                    found.append([low, high])
        return where, short

    def hits(self, text: str) -> list[dict]:
        """The nearest passage of each item that occurs in the (normal) text; of equal ones the first to end, and of those the shortest."""
        where, short = self._stretches(text)
        best = {number: (0, end, end - len(self.items[number][1])) for number, end in short.items()}
        for number, stretches in where.items():
            _, item, pattern, budget = self.items[number]
            joined: list[list[int]] = []
            for low, high in sorted(stretches):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], high)
                else:
                    joined.append([low, high])
            found = [(got[0], low + got[1]) for low, high in joined if (got := pattern.nearest(text[low:high], budget))]
            if found:
                distance, end = min(found)
                back = Pattern(item[::-1]).nearest(text[max(0, end - len(item) - distance) : end][::-1], distance, anchored=True)
                best[number] = (distance, end, end - back[1])
        return [{"item_id": self.items[k][0], "distance": d, "first": first, "end": end} for k, (d, end, first) in sorted(best.items(), key=lambda x: (self.items[x[0]][0], x[1]))]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in normal form."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks or 1))
    for k in range(blocks):
        rows = [(r.item_id, normal(r.text)) for r in items.where(block == k).collect()]
        yield sorted({r for r in rows if r[1]})


def _searched(docs: DataFrame, items: list[tuple[int, str]], rate: float, column: str) -> DataFrame:
    """``docs`` with a column of the hits of one block."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(shared.value, rate)
            hits = pa.array([matcher.hits(normal(t.as_py())) for t in batch.column("text")], pa.list_(_HIT))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hits], [*names, column])

    return docs.mapInArrow(search, with_fields(docs, f"`{column}` {_HITS}"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs`` and item found in it: doc_id, item_id, distance, first, end (characters of the normal text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_searched(texts, items, rate, "hits").select("doc_id", F.inline("hits")) for items in _blocks(benchmark) if items]
    none = texts.limit(0).select("doc_id", F.inline(F.array().cast(_HITS)))
    return reduce(lambda a, b: a.unionByName(b), found) if found else none


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are.  What each block but the last leaves is written before the next."""
    column, scratch = fresh(docs, "hits"), Scratch(docs.sparkSession)
    names = [F.col(f"`{c}`") for c in docs.columns]
    blocks = [items for items in _blocks(benchmark) if items]
    for k, items in enumerate(blocks):
        docs = _searched(docs, items, rate, column).where(F.size(f"`{column}`") == 0).select(*names)
        if k < len(blocks) - 1:
            docs = scratch.keep(docs, "without")
    return docs
