"""Operator 11: a mix of sources at target weights, in DataFrame operations only.

The words of a source's documents, in the order of (doc_id, size, hash of the text), are packed into blocks of
``BLOCK`` words that run over document borders.  Targets by source are turned into numbers of slots (a slot takes
one block), the slots are dealt over output shards of equal size, and each shard draws how many of its slots every
source gets: the whole part of what it expects, and a multinomial draw over what the whole parts leave, so that
the counts have the multinomial's mean and less of its noise.  The slots of a source, numbered through the shards, are
mapped to blocks by a pseudorandom permutation of the block numbers (swap-or-not rounds; another one for each epoch),
and blocks are joined by (source, number).  A slot beyond ``most`` epochs stays empty, so no word is taken more often.

Running sums over all documents or all sources go by ranges of the order: sums by range first, then inside each range
(``in_order``), so a source that holds most rows spreads over many tasks.

Defined cases: null text, or text without words, has size 0 and is taken 0 times; the null source is a source of
its own, the last one; rows with null or repeated doc_id stay rows of their own; an empty table gives an empty
result; a source without words has target 0.  Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, text_of

#: Words of a block, slots of an output shard, rounds of the permutation, and bins by which draws find their source.
BLOCK = 64
SHARD = 16384
ROUNDS = 8
BINS = 1024
SEED = "mix"
#: Weights of the sources in turn, the share of all words that the mix has, and how often a word is taken at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
_P = 2147483647


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def div(x: Column, by: Column | int) -> Column:
    """Whole division of whole numbers."""
    return F.call_function("div", x, by if isinstance(by, Column) else F.lit(by).cast("long"))


def in_order(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df``, and for each ``name: value`` a column with the sum of value over all rows that come before in ``order``.

    Rows are dealt by ranges of the order and written; sums by range (as many rows as ranges) are added up, and inside a range rows follow.
    """
    parts = scratch.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = parts.groupBy("_part").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {k: (F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long") for k, v in sums.items()}
    return parts.join(F.broadcast(totals), "_part").withColumns(own).drop("_part", *(f"_{k}" for k in sums))


def drawn(*parts: Column | int | str) -> Column:
    """A number below 2**60 that is the same for equal parts."""
    text = F.concat_ws("-", F.lit(SEED), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(scratch: Scratch, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, number, words_before, target) of the sources of ``sizes`` (source, size), numbered by code point with null last.

    ``share`` of all words is shared by weight; a target stops at ``most`` times its source's size and the excess is shared anew.  That is a common
    level: target = least(weight * level, most * size).  With the sources in the order of size / weight, the level that would hold were the
    first k stopped rises with k up to the right k and falls after it, so the largest is it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = in_order(scratch, by_source, [F.asc_nulls_last("source")], {"number": F.lit(1), "words_before": F.col("source_size")})
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    by_ratio = in_order(scratch, ranked, [F.col("source_size") / F.col("weight"), F.col("number")], {"_size": F.col("source_size"), "_weight": F.col("weight")})
    by_ratio = scratch.keep(by_ratio, "sources")
    words, weight = by_ratio.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (words or 0)) - F.lit(float(most)) * F.col("_size")) / (F.lit(weight) - F.col("_weight"))
    best = by_ratio.agg(F.max(level)).first()[0]
    target = F.least(F.col("weight") * F.lit(best or 0.0), F.lit(float(most)) * F.col("source_size"))
    return by_ratio.select("source", "source_size", "number", "words_before", target.alias("target"))


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Where ``index`` goes in a permutation of the numbers below ``n``: in each round an index and its mirror at a key change places, or not, by a bit that both share."""

    def one(x: Column, key: Column) -> Column:
        mirror = (key.mirror + n - x) % n
        upper = F.greatest(x, mirror)
        bit = (upper % _P * key.a + div(upper, _P) * key.b + key.b) % _P % 2
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(keys, index, one)


def _slots(scratch: Scratch, sources: DataFrame, block: int, shard: int, most: int) -> DataFrame:
    """(number, shard, place, index): the block each slot takes; place is the slot's number among its source's."""
    spark = sources.sparkSession
    blocks = div(F.col("source_size") + (block - 1), block)
    wanted = sources.where("source_size > 0").withColumn("n", blocks)
    wanted = scratch.keep(wanted.withColumn("slots", F.floor(F.col("target") * F.col("n") / F.col("source_size") + 0.5).cast("long")), "wanted")
    total = wanted.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard))
    each = -(-total // shards)
    share = F.col("slots") * F.lit(each)
    wanted = wanted.withColumns({"whole": div(share, max(total, 1)), "rest": share % max(total, 1)})
    left = each - (wanted.agg(F.sum("whole")).first()[0] or 0)
    whole = wanted.where("whole > 0").select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("whole").alias("count"))

    span = max(left * total, 1)
    width = -(-span // BINS)
    by_rest = in_order(scratch, wanted.where("rest > 0").select("number", "rest"), [F.col("number")], {"low": F.col("rest")}).withColumn("high", F.col("low") + F.col("rest"))
    by_rest = by_rest.select("number", "low", "high", F.explode(F.sequence(div(F.col("low"), width), div(F.col("high") - 1, width))).alias("bin"))
    draws = spark.range(shards * left).select(div(F.col("id"), max(left, 1)).alias("shard"), (drawn("draw", F.col("id")) % span).alias("at")).withColumn("bin", div(F.col("at"), width))
    by_draw = draws.join(by_rest, "bin").where("at >= low and at < high").groupBy("number", "shard").agg(F.count("*").alias("count"))

    counts = whole.unionByName(by_draw).groupBy("number", "shard").agg(F.sum("count").alias("count"))
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).join(wanted.select("number", "n"), "number")
    epochs = counts.withColumn("epoch", F.explode(F.sequence(div(F.col("start"), F.col("n")), div(F.col("start") + F.col("count") - 1, F.col("n"))))).where(F.col("epoch") < most)
    key = lambda r: drawn("key", F.col("number"), F.col("epoch"), r)
    keys = F.transform(F.array(*(key(r) for r in range(ROUNDS))), lambda v: F.struct((v % F.col("n")).alias("mirror"), (v % (_P - 1) + 1).alias("a"), (div(v, _P) % _P).alias("b")))
    epochs = epochs.withColumns({"keys": keys, "first": F.greatest(F.col("start"), F.expr("epoch * n")), "last": F.least(F.expr("start + count"), F.expr("(epoch + 1) * n")) - 1})
    spread = epochs.select("number", "shard", "n", "keys", "first", "last").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "number", "shard", "first")  # few rows that become many
    slots = spread.select("number", "shard", "n", "keys", F.explode(F.sequence("first", "last")).alias("place"))
    return slots.select("number", "shard", "place", permuted(F.col("place") % F.col("n"), F.col("n"), F.col("keys")).alias("index"))


def _planned(docs: DataFrame, more: tuple[str, ...], block: int, shard: int, weights, share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (row, doc_id, size, source, source_size, target, number, index, first_word, n_words) of documents in blocks, and slots."""
    scratch = Scratch(docs.sparkSession)
    text = text_of(docs, "doc_id", "text", "source")
    rows = text.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *more)
    rows = scratch.keep(rows, "sizes")
    sources = scratch.keep(source_targets(scratch, rows.select("source", "size"), weights, share, most), "targets")
    order = [F.asc_nulls_last("source"), F.asc_nulls_last("doc_id"), F.col("size"), F.col("tie")]
    rows = in_order(scratch, rows, order, {"row": F.lit(1), "start": F.col("size")})
    same = F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(sources.withColumnRenamed("source", "_source"), same).drop("_source").withColumn("start", F.col("start") - F.col("words_before"))
    index = F.when(F.col("size") > 0, F.sequence(div(F.col("start"), block), div(F.col("start") + F.col("size") - 1, block)))
    pieces = rows.select("row", "doc_id", "size", "source", "source_size", "target", "number", "start", *more, F.explode_outer(index).alias("index"))
    first = F.greatest(F.col("index") * block - F.col("start"), F.lit(0))
    n_words = F.least((F.col("index") + 1) * block - F.col("start"), F.col("size")) - first
    return pieces.withColumns({"first_word": first, "n_words": n_words}), _slots(scratch, sources, block, shard, most)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: (shard, slot, source, doc_id, first_word, n_words, text), a row for each piece of a document in a slot's block.

    Read a shard by ``slot`` (a pseudorandom number, the same for all pieces of a slot) and then by the order in which pieces are packed (``packed``).
    ``text`` has the piece's words with a space between them.
    """
    pieces, slots = _planned(docs, ("text",), block, shard, weights, share, most)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    taken = pieces.where("index is not null").withColumn("text", F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " "))
    both = taken.join(slots, ["number", "index"])
    return both.select("shard", drawn("slot", F.col("number"), F.col("place")).alias("slot"), F.col("row").alias("packed"), "source", "doc_id", "first_word", "n_words", "text")


def mix_report(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken (words of it in the mix, repeats counted)."""
    pieces, slots = _planned(docs, (), block, shard, weights, share, most)
    times = slots.groupBy("number", "index").agg(F.count("*").alias("times"))
    both = pieces.join(times, ["number", "index"], "left")
    taken = F.sum(F.coalesce(F.col("n_words") * F.col("times"), F.lit(0))).cast("long")
    return both.groupBy("row", "doc_id", "size", "source", "source_size", "target").agg(taken.alias("taken")).drop("row")
