"""Operator 8: toxic spans by a linear-chain conditional random field.

Training takes a bounded sample of labelled documents: drawn by hash of doc_id, never rows held out, at most ``SAMPLE`` of each
class and ``SAMPLE_BYTES`` bytes of text of each (a text that no longer fits is left out of training); of rows that share a doc_id one is taken.  Tokens get labels from the document labels:
a token of a toxic document is labelled if its form, or one of its beginnings, is tied to toxic
documents by a log-likelihood ratio of ``TIED`` or more.  The field is trained on three quarters of the sample, and a
small logistic model on the rest maps a document's marginals to its score.

Scoring reads every whole text once: hashed features, forward-backward, marginals; the document
score comes from the largest marginal and the sum of the marginals that are not small; tokens of
``SPAN`` or more are the offending ones, with character offsets.

Defined cases: null or empty text scores as a text without toxic tokens; without labels of both
classes every score is the smoothed share of toxic labels.  Labels that contradict each other for one doc_id, null labels and
labels of unknown documents are left out.  Rows with null or repeated doc_id stay separate rows (null: not held out).
Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .shared import Scratch, bounded, fresh, with_fields
from .wordhash import PUNCTUATION, Words, mix, text_chunks

SAMPLE = 2000
SAMPLE_BYTES = 1 << 23
PART_TOKENS = 50_000
SIZE = 1 << 20
TIED = 16.0
SPAN = 0.5
LEAST = 0.3
_BEGINNINGS = (3, 4, 5, 6)
_SALT = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, 9)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def token_features(words: Words) -> np.ndarray:
    """(tokens, 6) feature indices: the form, beginnings of 3 to 6 bytes (the form again where it is shorter), and the form's last 4 bytes."""
    s, e = words.start, words.end
    columns = [words.hash + _SALT[0]]
    columns += [words.span(s, np.minimum(s + k, e)) + _SALT[k - 2] for k in _BEGINNINGS]
    columns.append(words.span(np.maximum(e - 4, s), e) + _SALT[5])
    return np.stack([(mix(c) >> np.uint64(44)).astype(np.int32) for c in columns], axis=1)


def _tokens(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    for first, data, offsets in text_chunks(column):
        words = Words(data, offsets, separators=PUNCTUATION)
        yield first, words, token_features(words)


def _sample(docs: DataFrame, labels: DataFrame, each: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic, fold) of the sampled rows, and how many labelled rows there are of each class."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    clean = clean.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    totals = {r.toxic: r["count"] for r in clean.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for kind, n in totals.items():
        share = F.when(F.col("toxic") == kind, min(1.0, each / n)).otherwise(share)
    key = F.xxhash64("doc_id", F.lit("sample"))
    taken = clean.withColumn("key", key).where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    own = own.groupBy("key", "doc_id", "toxic").agg(F.min("text").alias("text"))
    own = Scratch(docs.sparkSession).keep(own.withColumn("bytes", F.octet_length("text")), "sample")
    parts = [bounded(own.where(F.col("toxic") == kind), "key", "bytes", each, SAMPLE_BYTES) for kind in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int").alias("fold")), totals


def _tied_features(sample: DataFrame, least: float) -> np.ndarray:
    """Features whose documents are toxic more often than by chance, by log-likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for first, words, features in _tokens(batch.column("text")):
                n = np.zeros((2, SIZE), np.int32)
                for i, (a, b) in enumerate(zip(words.row[:-1], words.row[1:])):
                    n[toxic[first + i], np.unique(features[a:b])] += 1
                some = np.flatnonzero(n.any(axis=0))
                yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.int32()), "clean": pa.array(n[0, some], pa.int64()), "toxic": pa.array(n[1, some], pa.int64())})

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    table = sample.select("toxic", "text").mapInArrow(count, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    mean = (F.col("a") + F.col("b")) / float(n0 + n1)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    ratio = 2 * (part(a, mean * n0) + part(b, mean * n1) + part(n0 - a, (1 - mean) * n0) + part(n1 - b, (1 - mean) * n1))
    often = (b * float(n0) > 20.0 * (a + 0.5) * float(n1)) & (ratio >= least)
    return np.array(sorted(r.feature for r in table.where(often).select("feature").collect()), dtype=np.int64)


def _gather(sample: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(toxic, fold, features) of the sampled documents: the bounded training set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, features in _tokens(batch.column("text")):
                n = len(words.row) - 1
                blobs = [features[a:b].tobytes() for a, b in zip(words.row[:-1], words.row[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in ("doc_id", "toxic", "fold")), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "fold", "features"])

    table = sample.select("doc_id", "toxic", "fold", "text").mapInArrow(pack, "doc_id long, toxic int, fold int, features binary").toArrow()
    table = table.sort_by([("doc_id", "ascending")])  # one row by doc_id
    blobs = (np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2 + len(_BEGINNINGS)) for x in table.column("features"))
    return list(zip(table.column("toxic").to_pylist(), table.column("fold").to_pylist(), blobs))


def _training_parts(rows: list[tuple[int, int, np.ndarray]], lexicon: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, starts) of runs of documents of about ``PART_TOKENS`` tokens."""
    part: list[tuple[int, int, np.ndarray]] = []
    for k, r in enumerate(rows):
        part.append(r)
        if k == len(rows) - 1 or sum(len(f) for _, _, f in part) >= PART_TOKENS:
            row = np.cumsum([0, *(len(f) for _, _, f in part)])
            features = np.concatenate([f for _, _, f in part])
            toxic = np.repeat([t for t, _, _ in part], np.diff(row))
            yield features, (lexicon[features].any(axis=1) & (toxic == 1)).astype(float), row[:-1]
            part = []


def _document_values(p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(documents, 2): the largest marginal, and log(1 + sum of those of 0.2 or more)."""
    n = len(row) - 1
    owner = np.repeat(np.arange(n), np.diff(row))
    most, total = np.zeros(n), np.bincount(owner, weights=np.where(p >= 0.2, p, 0.0), minlength=n)
    np.maximum.at(most, owner, p)
    return np.column_stack([most, np.log1p(total)])


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> dict:
    """The trained model: weights, theta, the document model, and the constant score where nothing can be learnt."""
    sample, totals = _sample(docs, labels, each)
    model = {"prior": (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)}
    if len(totals) < 2:
        return model
    tied = _tied_features(sample, TIED)
    rows = [r for r in _gather(sample) if len(r[2])]
    for_field = [r for r in rows if r[1]] or rows
    if not len(tied) or not for_field:
        return model
    lexicon = np.zeros(SIZE, dtype=bool)
    lexicon[tied] = True
    model["weights"], model["theta"] = crf.train(list(_training_parts(for_field, lexicon)), SIZE)
    if not {t for t, fold, _ in rows if not fold} >= {0, 1}:
        rest = rows
    else:
        rest = [r for r in rows if not r[1]]
    row = np.cumsum([0, *(len(f) for _, _, f in rest)])
    p = crf.marginals(np.concatenate([model["weights"][f].sum(axis=1) for _, _, f in rest]), row[:-1], model["theta"])
    kinds = np.array([t for t, _, _ in rest], float)
    share = {t: totals[t] / max(1, (kinds == t).sum()) for t in totals}
    weight = np.where(kinds == 1, share[1], share[0])
    model["document"] = crf.logistic(_document_values(p, row), kinds, weight * len(rest) / weight.sum())
    model["weights"] = model["weights"].astype(np.float32)
    return model


def _scored(docs: DataFrame, model: dict, score: str, spans: str) -> DataFrame:
    """``docs``, all columns as they are, with a score and the toxic spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, words, features in _tokens(batch.column("text")):
                n = len(words.row) - 1
                values, found = np.full(n, m["prior"]), [[] for _ in range(n)]
                if "weights" in m:
                    starts = words.row[:-1][np.diff(words.row) > 0]
                    p = crf.marginals(m["weights"][features].sum(axis=1, dtype=np.float64), starts, m["theta"])
                    z = np.column_stack([_document_values(p, words.row), np.ones(n)]) @ m["document"]
                    values = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    hot = np.flatnonzero(p >= SPAN)
                    if len(hot):
                        char = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                        owner = np.searchsorted(words.row, hot, side="right") - 1
                        begin = char[words.offsets[owner]]
                        for i, a, b, x in zip(owner.tolist(), (char[words.start[hot]] - begin).tolist(), (char[words.end[hot]] - begin).tolist(), p[hot].tolist()):
                            found[i].append({"first": a, "end": b, "score": x})
                rows = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, pa.float64()), pa.array(found, kind)], [*names, score, spans])

    return docs.mapInArrow(run, with_fields(docs, f"`{score}` double, `{spans}` array<struct<first:long,end:long,score:double>>"))


def toxicity(docs: DataFrame, labels: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``least`` on), spans (first and end character, marginal)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _scored(texts, fit(docs, labels, sample), "score", "spans")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns as they are.  Where nothing can be learnt, no row is rejected."""
    model = fit(docs, labels, sample)
    if "weights" not in model:
        return docs
    score, spans = fresh(docs, "score"), fresh(docs, "spans")
    return _scored(docs, model, score, spans).where(F.col(f"`{score}`") < least).select(*(F.col(f"`{c}`") for c in docs.columns))
