"""Operator 7: licence notices by diagonal voting, in DataFrame operations only.

All rolling word 3-grams of all texts are exploded and joined by hash to the (small, fixed)
table of template positions; a hit counts only if its words are equal too.  A hit at text
word p and template word q votes for diagonal p - q.  Votes are summed by row, template and
diagonal, neighbouring diagonals (up to ``SLACK`` words apart, so that inserted or missing words do
not break a span) are merged, and a span is verified by the share of the template's words that
its hits cover.  Where spans of several labels lie on one another, so that half of one is in another of higher score (of equal ones the
longer template), the one goes.  Exact base phrases are found beside it and keep their labels.

Defined cases: null text is empty; without words n_words is 0, the labels are '' and the score 0.
first_word and last_word are null where no base phrase stands.  Rows with null or repeated
doc_id stay separate rows; equal rows get equal results.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: What separates words, and the base phrases.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_templates(text: str) -> tuple[tuple[str, str], ...]:
    """(label, words) of the paragraphs ``label: text``; those that begin with # are remarks."""
    parts = [p.split(":", 1) for p in re.split(r"\n\s*\n", text.strip()) if not p.startswith("#")]
    return tuple((label.strip(), " ".join(w for w in re.split(SEPARATORS, body.translate(str.maketrans(*_FOLD))) if w)) for label, body in parts)


#: The notices that the method knows: a small table of label and words.
TEMPLATES = read_templates((files(__package__) / "licences.txt").read_text(encoding="utf-8"))
GRAM = 3
SLACK = 2
COVERED = 0.7
#: Words of a stretch in which spans of a text are compared.
NEAR = 256


def words_of(text: Column) -> Column:
    """Words, A-Z in lower case."""
    folded = F.translate(F.coalesce(text, F.lit("")), *_FOLD)
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def template_positions(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, size, at, t0, t1, t2): every 3-gram of every template; as long as the templates are."""
    rows = []
    for number, (label, text) in enumerate(templates):
        w = text.split()
        rows += [(number, label, len(w), at, *w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, "template int, label string, size int, at int, t0 string, t1 string, t2 string")


def _base_places(words: Column) -> Column:
    """Array of (place, label) of all base phrases."""
    first = sorted({p.split()[0] for p in BASE})

    def label_at(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            hit = F.lit(True)
            for k, part in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get(w, i + k) == part, F.lit(False))
            out = F.when(hit, F.lit(label)).otherwise(out)
        return out

    places = F.transform(F.array(words), lambda w: F.filter(F.transform(w, lambda _, i: F.struct(i.cast("long").alias("place"), label_at(w, i).alias("label"))), lambda x: x.label.isNotNull()))[0]
    some = F.lit(False)
    for w in first:
        some = some | F.array_contains(words, w)
    return F.when(some, places).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def _best(spans: DataFrame) -> DataFrame:
    """Spans less those of which half lies in one of another label that is better.

    Only spans that share a stretch of ``NEAR`` words of one text meet, so the work grows with a text's spans and not with their square.
    """
    names = spans.columns
    bins = F.explode(F.sequence(F.floor(F.col("first_word") / NEAR), F.floor(F.col("last_word") / NEAR)))
    here = spans.withColumn("bin", bins)
    there = here.select("k1", "k2", "bin", *(F.col(c).alias(f"t_{c}") for c in names[2:]))
    common = F.least("last_word", "t_last_word") - F.greatest("first_word", "t_first_word") + 1
    better = (F.col("t_score") > F.col("score")) | ((F.col("t_score") == F.col("score")) & (F.col("t_size") > F.col("size")))
    covered = (F.col("label") != F.col("t_label")) & better & (2 * common >= F.col("last_word") - F.col("first_word") + 1)
    return spans.join(here.join(there, ["k1", "k2", "bin"]).where(covered).select(*names).distinct(), names, "left_anti")


def license_scan(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the method's verified spans (label, first_word, last_word, score).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = docs.select("doc_id", "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})
    rows = text.select("doc_id", "k1", "k2", words_of(F.col("text")).alias("words"))

    grams = F.arrays_zip(F.col("words").alias("w0"), F.expr("slice(words, 2, size(words))").alias("w1"), F.expr("slice(words, 3, size(words))").alias("w2"))
    each = rows.select("k1", "k2", F.posexplode(grams).alias("place", "g")).select("k1", "k2", "place", "g.*").where("w2 is not null")
    known = template_positions(spark, templates).withColumn("hash", F.xxhash64("t0", "t1", "t2"))
    hits = each.withColumn("hash", F.xxhash64("w0", "w1", "w2")).join(F.broadcast(known), "hash").where("w0 = t0 and w1 = t1 and w2 = t2")
    hits = hits.select("k1", "k2", "template", "label", "size", "at", "place").distinct()

    diagonal = hits.groupBy("k1", "k2", "template", "label", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("at"), F.min("place").alias("first_word"), F.max("place").alias("last_word"))
    near = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True)).cast("int")
    merged = diagonal.withColumn("opens", opens).withColumn("span", F.sum("opens").over(near))
    spans = merged.groupBy("k1", "k2", "template", "label", "size", "span").agg(F.flatten(F.collect_list("at")).alias("at"), F.min("first_word").alias("first_word"), (F.max("last_word") + GRAM - 1).alias("last_word"))
    found = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + GRAM - 1)))))
    spans = spans.withColumn("score", found / F.col("size")).where(F.col("score") >= covered)
    spans = spans.select("k1", "k2", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "label", "score", "size").distinct()
    spans = _best(scratch.keep(spans, "verified"))
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("first_word", "last_word", "label", "score"))).alias("spans"))

    base = scratch.keep(rows.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), _base_places(F.col("words")).alias("base")), "base")
    out = base.join(scratch.keep(spans, "spans"), ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first_word:bigint,last_word:bigint,label:string,score:double>>")))
    n_base = F.size("base").cast("long")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0))
    labels = F.array_union(F.transform("base", lambda b: b.label), F.transform("spans", lambda s: s.label))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(F.transform("base", lambda b: b.place)).alias("first_word"), F.array_max(F.transform("base", lambda b: b.place)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b.label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans",
    )
