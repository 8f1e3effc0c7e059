"""Operator 5: distribution divergence, in DataFrame operations only.

Each text gets two histograms: of character classes, and of words (the common words of the reference
languages, and all others in one bin).  The references are the summed histograms of all documents by language.  A text is
rejected if even its nearest reference is farther than a limit in Jensen-Shannon distance
(base 2, so 0 to 1), for either histogram; texts under ``MIN_CHARS`` characters or
``MIN_WORDS`` words are too short to judge by that histogram and pass.

Texts are read once into a small table of counts; references and verdicts come from that.
Defined cases: null text has no words (all counts 0, base_failed).  Rows with null or
repeated doc_id stay separate rows.  A null or unknown lang adds to no reference but is judged as any.
With no reference (an empty table, or no known language) nothing is judged by this method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: White space between words, symbol characters, and common words of the reference languages.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
COMMON = {
    "en": "the of and to in a is that for it with as was on be by this are from or an he she not",
    "de": "der die das und in zu den von mit sich ist des dem nicht ein eine als auf für auch im es an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur il ce avec",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más",
}
MIN_CHARS = 400
MIN_WORDS = 100
CHARS_APART = 0.30
WORDS_APART = 0.32


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in 3-word windows found twice or more, all occurrences included.

    Windows are compared by 64-bit hash.  A text with few distinct repeats is searched for them;
    otherwise (hash, place) pairs are sorted, so the work stays near-linear in the text.
    """
    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def by_search(h: Column, dup: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(dup, x), i)), lambda i: i.isNotNull())

    def by_sort(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: F.array_sort(F.filter(F.transform(p, lambda x, i: F.when(F.coalesce(F.get(p, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(p, i + 1).h == x.h, F.lit(False)), x.i)), lambda i: i.isNotNull())))

    def count(h: Column) -> Column:
        same = lambda s: F.array_distinct(F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
        dup = F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.sort_array(h), same)).otherwise(F.array().cast("array<bigint>"))
        return _let(dup, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(_let(F.when(F.size(d) <= 64, by_search(h, d)).otherwise(by_sort(h)), covered)))

    hashes = _let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def counts(docs: DataFrame, common=COMMON) -> DataFrame:
    """Per row: doc_id, lang, the base counts, and the two histograms as arrays."""
    bins = sorted({w for ws in common.values() for w in ws.split()})
    # what is left of the text after each step; a class has the characters that its step took away
    docs = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("words", words_of(F.col("text"))).withColumn("r0", F.regexp_replace("text", "[a-z]+", ""))
    steps = [("r1", SPACES), ("r2", "[A-Z]+"), ("r3", "[0-9]+"), ("r4", "[.,;:!?'\"()-]+"), ("r5", SYMBOLS), ("r6", r"\p{L}+")]
    for k, (name, taken) in enumerate(steps):
        docs = docs.withColumn(name, F.regexp_replace(f"r{k}", taken, ""))
    length = lambda c: F.char_length(c).cast("long")
    classes = [length("text") - length("r0")] + [length(f"r{k}") - length(f"r{k + 1}") for k in range(len(steps))] + [length("r6")]
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hits = F.filter("words", lambda w: w.isin(bins))
    by_word = _let(hits, lambda h: F.transform(F.array(*map(F.lit, bins)), lambda b: (F.size(h) - F.size(F.array_remove(h, b))).cast("long")))
    by_word = F.concat(by_word, F.array((F.size("words") - F.size(hits)).cast("long")))
    return docs.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), (length("text") - length("r0") + length("r1")).alias("word_chars"),
        (length("r4") - length("r5")).alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.array(*classes).alias("classes"), by_word.alias("common"),
    )


def _share(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("double"), lambda s, x: s + x)
    return _let(total, lambda t: F.transform(histogram, lambda x: F.when(t > 0, x / t).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))


def references(table: DataFrame, languages) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of the summed histograms of all documents, by reference language (a fixed, small number)."""
    n_classes, n_bins = 8, len({w for ws in languages.values() for w in ws.split()}) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_bins)]
    out = {}
    for r in table.where(F.col("lang").isin(list(languages))).groupBy("lang").agg(*sums).collect():
        parts = [[r[f"c{i}"] for i in range(n_classes)], [r[f"w{i}"] for i in range(n_bins)]]
        if all(map(sum, parts)):
            out[r.lang] = tuple([x / sum(part) for x in part] for part in parts)
    return out


def quality_rules(docs: DataFrame, common=COMMON, chars_apart: float = CHARS_APART, words_apart: float = WORDS_APART) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the distances.

    A distance is null where the text is too short for it.
    """
    table = Scratch(docs.sparkSession).keep(counts(docs, common), "counts")
    known = references(table, common)

    def nearest(histogram: str, which: int, least: int) -> Column:
        if not known:
            return F.lit(None).cast("double")
        total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, x: s + x)
        to = [F.array(*map(F.lit, known[x][which])) for x in sorted(known)]
        apart = _let(_share(F.col(histogram)), lambda p: F.array_min(F.array(*(js_distance(p, q) for q in to))))
        return F.when(total >= least, apart)

    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.withColumns({"base_failed": base_failed, "chars_distance": nearest("classes", 0, MIN_CHARS), "words_distance": nearest("common", 1, MIN_WORDS)})
    far = F.coalesce(F.col("chars_distance") > chars_apart, F.lit(False)) | F.coalesce(F.col("words_distance") > words_apart, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "chars_distance", "words_distance")
