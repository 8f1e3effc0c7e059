"""Operator 1: a quality classifier from weak labels.

Nine heuristic labellers vote good (1), bad (-1) or not at all (0) on every document, in the JVM, and the votes are written beside the texts.  They
are counted by pattern (at most 3**9, whatever the corpus), and expectation-maximisation over the
pattern counts estimates each labeller's vote rates for good and bad documents and the share of good ones;
no true label is used.  The posterior of its pattern labels each document, and a
logistic scorer over hashed words and word shapes is trained on a bounded sample: distinct texts drawn by hash, each with the number of
rows that have it as its weight, at most ``SAMPLE`` texts of ``SAMPLE_BYTES`` bytes together (a text that no longer
fits is left out of training).  The scorer reads every whole text.

Defined cases: null text counts as empty; texts without words have one feature, their length class.
If the votes do not tell documents apart (say, an empty table), every score is the posterior share of good ones.
Rows with null or repeated doc_id stay separate rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, bounded
from .wordhash import Words, mix, text_chunks

#: Common words of the expected languages.
COMMON = "the of and to in is that for with der die das und den von mit ist nicht de la le et les des un une que est pour el los del se por con para no".split()
LABELLERS = ("symbols", "common_words", "upper_case", "repeated_lines", "repeated_words", "word_length", "length", "exclamation", "digits")
SAMPLE = 4000
SAMPLE_BYTES = 1 << 24
SIZE = 1 << 18
KEEP_FROM = 0.5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[b for b in range(256) if chr(b).islower() or b >= 128]] = ord("a")
_SHAPE[[b for b in range(128) if chr(b).isupper()]] = ord("A")
_SHAPE[[b for b in range(128) if chr(b).isdigit()]] = ord("0")


def _votes(text: Column) -> dict[str, Column]:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")
    count = lambda pattern: F.char_length(rest) - F.char_length(F.regexp_replace(rest, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return {
        "chars": F.char_length(text), "n": F.size(words), "distinct": F.size(F.array_distinct(words)),
        "common": F.size(F.filter(words, lambda w: w.isin(COMMON))), "symbols": count(r"[#*$%&|<>]+"), "upper": count("[A-Z]+"), "digits": count("[0-9]+"),
        "marks": count("[!]+"), "rest": F.char_length(rest), "lines": F.size(lines), "own_lines": F.size(F.array_distinct(lines)),
    }


def votes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text, and ``votes``: one of -1, 0, 1 for each of LABELLERS, as an array."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select("doc_id", "text", F.struct(*(c.alias(k) for k, c in _votes(F.col("text")).items())).alias("v"))
    c = lambda name: F.col(f"v.{name}").cast("double")
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    n = c("n")
    never = F.lit(False)
    marks = [
        vote(share(c("symbols"), c("chars")) > 0.01, never),
        vote((n >= 30) & (share(c("common"), n) < 0.08), share(c("common"), n) > 0.15),
        vote(share(c("upper"), c("chars")) > 0.2, never),
        vote(share(c("lines") - c("own_lines"), c("lines")) > 0.3, never),
        vote((n >= 40) & (share(c("distinct"), n) < 0.2), (n >= 40) & (share(c("distinct"), n) > 0.35)),
        vote((n > 0) & ((share(c("chars"), n) < 3.5) | (share(c("chars"), n) > 9)), never),
        vote(n < 20, n >= 100),
        vote(share(c("marks"), n) > 0.1, never),
        vote(share(c("digits"), c("chars")) > 0.15, never),
    ]
    return rows.select("doc_id", "text", F.array(*marks).alias("votes"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns with counts: share of good documents, (2, labellers, 3) vote rates, and each pattern's posterior."""
    x = np.array([p for p, _ in patterns], dtype=int) + 1
    n = np.array([k for _, k in patterns], dtype=float)
    k = x.shape[1]
    balance = (x - 1).sum(axis=1)
    good = 1 / (1 + np.exp(-1.5 * balance))
    for _ in range(rounds):
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        rates = np.empty((2, k, 3))
        for y, q in enumerate((1 - good, good)):
            for v in range(3):
                rates[y, :, v] = ((n * q)[:, None] * (x == v)).sum(axis=0) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        ll = np.log(rates[:, np.arange(k), x]).sum(axis=2)
        z = np.clip(np.log(prior / (1 - prior)) + ll[1] - ll[0], -40, 40)
        good = 1 / (1 + np.exp(-z))
    return prior, rates, good


def _features(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Hashed features of each word: its form, and the shapes of its beginning and its end."""
    for first, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        shapes = Words(_SHAPE[data], offsets, fold=False)
        s, e = words.start, words.end
        columns = [words.hash, shapes.span(s, np.minimum(s + 3, e)) + np.uint64(1), shapes.span(np.maximum(e - 3, s), e) + np.uint64(2)]
        yield first, words, np.stack([(mix(c) >> np.uint64(46)).astype(np.int32) for c in columns], axis=1)


def _values(weights: np.ndarray, features: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of a document's mean feature weight (tenfold) and the weight of its length class."""
    n = np.diff(row)
    total = np.concatenate([[0.0], np.cumsum(weights[features].sum(axis=1, dtype=np.float64))])
    size = np.minimum(np.log2(n + 1).astype(int), 31)
    return 10 * (total[row[1:]] - total[row[:-1]]) / np.maximum(n, 1) + weights[SIZE + size]


def train(rows: list[tuple[float, float, np.ndarray]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (SIZE hashed features and 32 length classes) for rows of soft label, weight and features, by adaptive gradient ascent."""
    row = np.cumsum([0, *(len(f) for _, _, f in rows)])
    features = np.concatenate([f for _, _, f in rows])
    y, weight = np.array([p for p, _, _ in rows]), np.array([k for _, k, _ in rows], float)
    weight *= len(rows) / weight.sum()
    n = np.diff(row)
    size = SIZE + np.minimum(np.log2(n + 1).astype(int), 31)
    w, seen = np.zeros(SIZE + 32), np.full(SIZE + 32, 1e-6)
    owner = np.repeat(np.arange(len(rows)), n)
    for _ in range(rounds):
        error = weight * (y - 1 / (1 + np.exp(-np.clip(_values(w, features, row), -30, 30))))
        each = (10 * error / np.maximum(n, 1))[owner]
        g = np.bincount(size, weights=error, minlength=SIZE + 32)
        for column in features.T:
            g += np.bincount(column, weights=each, minlength=SIZE + 32)
        g -= l2 * len(y) * w
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return w.astype(np.float32)


def quality_scores(docs: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row of ``docs``: doc_id, posterior (of its vote pattern), score (the scorer's, 0 to 1), kept (score of KEEP_FROM or more)."""
    spark = docs.sparkSession
    marked = Scratch(spark).keep(votes(docs), "votes")
    counted = [(tuple(r.votes), r["count"]) for r in marked.groupBy("votes").count().collect()]
    counted.sort()
    known: dict[tuple[int, ...], float] = {}
    prior = 0.5
    if counted:
        prior, _, good = estimate(counted)
        known = {p: float(g) for (p, _), g in zip(counted, good)}
    table = spark.createDataFrame([(list(p), g) for p, g in known.items()], "votes array<int>, posterior double")
    total = sum(k for _, k in counted)
    labelled = marked.join(F.broadcast(table), "votes")

    drawn = marked.withColumn("key", F.xxhash64("text", F.lit("sample"))).where(F.pmod("key", F.lit(1 << 20)) < min(1.0, sample / max(total, 1)) * (1 << 20))
    drawn = drawn.groupBy("key", "votes").agg(F.count("*").alias("rows"), F.min("text").alias("text")).dropDuplicates(["key"])
    taken = bounded(drawn.withColumn("bytes", F.octet_length("text")), "key", "bytes", sample, SAMPLE_BYTES).join(F.broadcast(table), "votes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, features in _features(batch.column("text")):
                blobs = [features[a:b].tobytes() for a, b in zip(words.row[:-1], words.row[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(blobs)) for c in ("posterior", "rows")), pa.array(blobs, pa.binary())], ["posterior", "rows", "features"])

    rows = [(r.posterior, r.rows, bytes(r.features)) for r in taken.select("posterior", "rows", "text").mapInArrow(pack, "posterior double, rows long, features binary").collect()]
    rows = [(p, k, np.frombuffer(b, np.int32).reshape(-1, 3)) for p, k, b in sorted(rows)]
    weights = train(rows) if any(p > 0.5 for p, _, _ in rows) and any(p < 0.5 for p, _, _ in rows) else None
    shared = spark.sparkContext.broadcast((weights, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = shared.value
        for batch in batches:
            for first, words, features in _features(batch.column("text")):
                n = len(words.row) - 1
                values = np.full(n, prior) if weights is None else 1 / (1 + np.exp(-np.clip(_values(weights, features, words.row), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in ("doc_id", "posterior")), pa.array(values, pa.float64())], ["doc_id", "posterior", "score"])

    scored = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "posterior", "text").mapInArrow(score, "doc_id long, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= keep_from)
