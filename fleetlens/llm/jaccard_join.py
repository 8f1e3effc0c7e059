"""Operator 3: Jaccard self-join of word n-gram sets.

Plan, for sets of distinct n-word shingles (as 64-bit hashes) and a threshold of t per cent:

* texts with equal sets form one class at once; its smallest doc_id stands for it;
* corpus frequencies of the shingles are counted (packed and combined in the tasks), and those
  of ``FREQUENT`` rows or more are the frequent ones;
* rare-first order: shingles that are not frequent by hash, then the frequent ones by frequency; the first
  n - ceil(t n) + 1 of a set are its prefix, and two linked sets share a shingle of both prefixes;
* prefix rows meet by shingle.  In each group every member is first paired with the one that
  has the shingle earliest in its order, so the fewest rarer ones: of near copies the least changed
  (a star, linear in the group); pairs pass length, positional and suffix filters,
  and each pair that is left is verified once on the whole sets;
* groups whose members are then still in several components pair members of different
  components that were not verified yet.  One of the two is outside the group's largest component, so copies
  never pair off among themselves; and the two meet by ranges of length, each of which a partner of that
  place in the other's order can have, so members that no partner can reach are not paired at all.  Shingles with the same members, as those of a passage that texts share, make one group.  No link between
  components is missed.

Frequent shingles are salted by their frequency, verification by the number of a document's pairs: its set travels once
for each ``PAIRS`` of them.  Defined cases: null or empty text, or text without words, has
an empty set and no links (component_id is its own doc_id); a null doc_id takes no part and
gets a null component_id; rows that repeat a doc_id are one node with several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import membership
from .graph import components
from .shared import Scratch, fresh
from .wordhash import Words, mix, shingle_sets, text_chunks

#: Rows from which on a shingle counts as frequent.
FREQUENT = 32
#: Frequent shingles that are sent to all tasks at most (24 bytes each); with more, they are joined.
BROADCAST_LIMIT = 2_000_000
#: Rows of a frequent shingle's group that one salt holds, about.
SALT_ROWS = 1000
#: Keys that one counting group holds, about.
SLOT_KEYS = 1_000_000
#: Pairs of one document that are verified under one key, about.
PAIRS = 256
#: Ranges of hash whose sizes the suffix filter compares (a power of two).
_RANGES = 128
#: Words of 64 bits, each bit the parity of a range's size, that members of open groups carry into their join.
_WORDS = 8
_DOC = "doc_id long, n int, low long, high long"


def _needed(n, percent: int):
    """ceil(percent * n / 100) in integers."""
    return -(-percent * n // 100)


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set, equal for equal sets."""
    low = [mix(s).sum(dtype=np.uint64) for s in sets]
    high = [mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets]
    return np.array(low, np.uint64).view(np.int64), np.array(high, np.uint64).view(np.int64)


def _scan(docs: DataFrame, words: int, make, schema: str, with_empty: bool = False, among=None) -> DataFrame:
    """Run ``make(ids, sets)`` over runs of rows; it returns a record batch or None.  With ``among`` (a membership filter) other ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if among is not None:
                batch = batch.filter(pa.array(membership.maybe(among.value, batch.column(0).fill_null(-1).to_numpy())))
            ids = batch.column(0)
            for first, data, offsets in text_chunks(batch.column(1)):
                sets = list(shingle_sets(Words(data, offsets), words))
                own = ids.slice(first, len(sets))
                if not with_empty:
                    has = [i for i, s in enumerate(sets) if len(s) and own[i].is_valid]
                    own, sets = own.take(pa.array(has, pa.int64())), [sets[i] for i in has]
                if sets and (out := make(own, sets)) is not None:
                    yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """One row per row of ``docs``: its set's size, marks, sizes by range of hash, and parities of the sizes of finer ranges (for the suffix filter)."""

    def make(ids, sets):
        low, high = _marks(sets)
        sizes = [np.bincount((s >> np.uint64(65 - _RANGES.bit_length())).astype(np.int64), minlength=_RANGES) for s in sets]
        bits = [np.packbits(np.bincount((s >> np.uint64(58)).astype(np.int64) * _WORDS + (s >> np.uint64(20)).astype(np.int64) % _WORDS, minlength=64 * _WORDS) & 1).view(np.int64) for s in sets]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * size, pa.int32()), pa.array(np.concatenate(x), kind)) for x, size, kind in ((sizes, _RANGES, pa.int32()), (bits, _WORDS, pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(low), pa.array(high), *lists], ["doc_id", "n", "low", "high", "ranges", "bits"])

    return _scan(docs, words, make, f"{_DOC}, ranges array<int>, bits array<long>", with_empty=True)


def frequent_shingles(docs: DataFrame, words: int, total: int, least: int) -> DataFrame:
    """(key, df): the top 48 bits of every shingle that ``least`` rows or more have, with their number.

    Keys travel packed by slot, those of several rows of a run with a count, so a shuffle
    row holds many keys and a shingle of all rows costs one entry a run.
    """
    slots = max(12, -(-total // SLOT_KEYS))

    def make(_, sets):
        keys, n = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
        slot = ((keys >> np.uint64(16)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)  # rises with the key
        cut = np.flatnonzero(np.diff(slot, prepend=-1))
        packed, more, slot_of = [], [], []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
            k, c = keys[a:b], n[a:b]
            packed.append(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            more.append(np.stack([k[c > 1], (c[c > 1] - 1).astype(np.uint64)]).tobytes())
            slot_of.append(int(slot[a]))
        return pa.RecordBatch.from_pydict({"slot": pa.array(slot_of, pa.int64()), "keys": pa.array(packed, pa.binary()), "more": pa.array(more, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, :6] = packed
        keys, df = np.unique(wide.view("<u8").ravel(), return_counts=True)
        for blob in table.column("more").to_pylist():
            k, c = np.frombuffer(blob, np.uint64).reshape(2, -1)
            df[np.searchsorted(keys, k)] += c.astype(np.int64)
        often = df >= least
        return pa.table({"key": pa.array(keys[often].astype(np.int64)), "df": pa.array(df[often].astype(np.int64))})

    packed = _scan(docs, words, make, "slot long, keys binary, more binary")
    return packed.groupBy("slot").applyInArrow(count, "key long, df long")


def _prefix_rows_broadcast(docs: DataFrame, words: int, percent: int, frequent: DataFrame) -> DataFrame:
    """Prefix rows of each class's first document; the frequent shingles are known in every task."""
    known = frequent.orderBy("key").toArrow()
    keys, dfs = (known.column(c).to_numpy().copy() for c in ("key", "df"))
    shared = docs.sparkSession.sparkContext.broadcast((keys.astype(np.uint64), dfs))

    def make(ids, sets):
        keys, dfs = shared.value
        low, high = _marks(sets)
        out = []
        for s in sets:
            k = s >> np.uint64(16)
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            df = np.where(keys[at] == k, dfs[at], 0) if len(keys) else np.zeros(len(s), np.int64)
            order = np.argsort(df, kind="stable")[: len(s) - _needed(len(s), percent) + 1]  # s is sorted: ties by hash
            out.append(np.stack([s[order].view(np.int64), df[order]]).tobytes())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(low), pa.array(high), pa.array(out, pa.binary())], ["doc_id", "n", "low", "high", "prefix"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b, np.int64).reshape(2, -1) for b in batch.column("prefix").to_pylist()]
            if not parts:
                continue
            size = np.array([p.shape[1] for p in parts])
            row = np.repeat(np.arange(len(parts)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            token, df = np.concatenate(parts, axis=1)
            own = pa.array(row)
            for i in range(0, len(row), 200_000):
                cut = slice(i, i + 200_000)
                mine = [batch.column(c).take(own[cut]) for c in ("doc_id", "low", "n")]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(token[cut]), pa.array(df[cut]), pa.array(pos[cut].astype(np.int32))], ["doc_id", "low", "n", "token", "df", "pos"])

    each = _scan(docs, words, make, f"{_DOC}, prefix binary")
    first = each.groupBy("low", "high", "n").agg(F.min(F.struct("doc_id", "prefix")).alias("f")).select("f.doc_id", "low", "n", "f.prefix")
    return first.mapInArrow(unpack, "doc_id long, low long, n int, token long, df long, pos int")


def _prefix_rows_join(docs: DataFrame, words: int, percent: int, frequent: DataFrame) -> DataFrame:
    """The same rows where the frequent shingles are too many to send: every shingle of a class's set is joined to its frequency."""

    def make(ids, sets):
        low, high = _marks(sets)
        flat = pa.array(np.concatenate(sets).view(np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(low), pa.array(high), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n", "low", "high", "tokens"])

    each = _scan(docs, words, make, f"{_DOC}, tokens array<long>")
    first = each.groupBy("low", "high", "n").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))  # rows of a class have equal tokens
    rows = first.select("doc_id", "n", "low", "high", F.explode("tokens").alias("token"))
    rows = rows.withColumn("key", F.shiftrightunsigned("token", 16)).join(frequent, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = Window.partitionBy("low", "high", "n").orderBy("df", F.shiftrightunsigned("token", 1), "token")
    rows = rows.withColumn("pos", F.row_number().over(own) - 1).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    return rows.select("doc_id", "low", "n", "token", "df", "pos")


def _may_link(percent: int, n: str, pos: str, m: str, at: str) -> Column:
    """Length and positional filter of two prefix rows; a true pair passes at its first common shingle."""
    n, pos, m, at = (F.col(x).cast("long") for x in (n, pos, m, at))
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = 1 + F.least(n - pos, m - at) - 1
    return fits & (most * (100 + percent) >= (n + m) * percent)


def _length_range(n: Column) -> Column:
    """Each length up to 40 by itself, then ranges of 2.5 per cent."""
    return F.when(n <= 40, n).otherwise(40 + F.floor(F.log(n / 40.0) / math.log(1.025))).cast("int")


def _reach(rows: DataFrame, percent: int, longer: bool) -> DataFrame:
    """A row for each range of length (``other``) of partners that ``_may_link`` allows a prefix row; partners as long or longer, or as long or shorter."""
    n, pos = F.col("n").cast("long"), F.col("pos").cast("long")
    most = F.floor((n - pos) * (100 + percent) / percent) - n
    low, high = (n, F.least(F.floor(n * 100 / percent), most)) if longer else (F.ceil(n * percent / 100), F.least(n, most))
    reached = F.when(high >= low, F.sequence(_length_range(low), _length_range(high)))
    return rows.withColumns({"own": _length_range(n), "other": F.explode(reached)})


def _open_groups(rows: DataFrame) -> DataFrame:
    """(token, main) of the groups of ``rows`` (token, doc_id, low, pos, component) in several components, one group for all tokens of the same members.

    Tokens of a passage that texts share as a whole have the same members; their places rise in one order in all
    of them, so the token of the least sum of places is the first that any two members share here, by which a pair
    is judged.  Equal members are told by their number and 120 bits of sums of hashes.
    """
    member = [F.xxhash64("low", "doc_id"), F.xxhash64("doc_id", "low")]
    parts = [F.shiftrightunsigned(h, shift).bitwiseAND((1 << 30) - 1) for h in member for shift in (0, 32)]
    sums = [f"sum_{i}" for i in range(len(parts))]
    by_part = rows.groupBy("token", "component").agg(F.count("*").alias("rows"), F.sum("pos").alias("places"), *(F.sum(p).alias(s) for p, s in zip(parts, sums)))
    main = F.max_by("component", F.struct("rows", "component")).alias("main")
    by_token = by_part.groupBy("token").agg(main, F.count("*").alias("parts"), *(F.sum(c).alias(c) for c in ("rows", "places", *sums)))
    return by_token.where("parts > 1").groupBy("rows", *sums).agg(F.min_by("token", F.struct("places", "token")).alias("token"), F.first("main").alias("main")).select("token", "main")


def _apart_enough(apart: Column, both: Column, percent: int) -> Column:
    """Whether sets of ``both`` shingles together can be linked when at least ``apart`` of them are in one set only."""
    return (both - apart) * (100 + percent) >= both * 2 * percent


def _with_bits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (doc_id, low and others) with the parities of their sets."""
    sets = table.where("n > 0 and doc_id is not null").select("doc_id", "low", "bits").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.join(sets.groupBy("doc_id", "low").agg(F.first("bits").alias("bits")), ["doc_id", "low"]).drop("low")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components of a group that pass the filters.

    ``rows`` has token, doc_id, n, pos, component, bits, and main, the group's largest component.  Where the parities of a range differ,
    a shingle is in one set only; this form of the suffix filter is part of the join, so members that share little more than the group's passage never leave it as pairs.
    """

    def side(part: DataFrame, longer: bool, names: tuple[str, ...], prefix: str) -> DataFrame:
        columns = zip(("doc_id", "n", "pos", "component", "own", "other"), names)
        return _reach(part, percent, longer).select("token", *(F.col(x).alias(y) for x, y in columns), *(F.col("bits")[i].alias(f"{prefix}{i}") for i in range(_WORDS)))

    one, two = ("a", "n", "pos", "component", "own", "other"), ("b", "m", "at", "c", "other", "own")
    rest = rows.where("component <> main")
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(_WORDS)))
    near = _apart_enough(apart, F.col("n").cast("long") + F.col("m"), percent)
    out = None
    for longs, shorts in ((rest, rows), (rows.where("component = main"), rest)):
        met = side(longs, False, one, "x").join(side(shorts, True, two, "y"), ["token", "own", "other"])
        met = met.where("component <> c and (n > m or n = m and a < b)").where(_may_link(percent, "n", "pos", "m", "at")).where(near).select("a", "b")
        # two members outside the largest component meet once where their lengths differ, from either side where they are equal
        out = met if out is None else out.unionByName(met)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, table: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, as links (u, v)."""
    sizes = table.where("n > 0 and doc_id is not null").groupBy("doc_id", "low", "high").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"ranges_{x}"))
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, x: s + x)
    both = (F.col("n_a") + F.col("n_b")).cast("long")
    near = _apart_enough(apart, both, percent)
    pairs = scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b").distinct(), "pairs")

    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("pairs")), "ids")
    needed = membership.build(ids, "doc_id")

    def make(own, sets):
        return pa.RecordBatch.from_arrays([own, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    sets = scratch.keep(_scan(docs, words, make, "doc_id long, set binary", among=needed).join(ids, "doc_id"), "sets")
    # the document of more pairs is the head of a pair: its set goes to each salt once, the other's to each of its few pairs
    many = lambda x: ids.select(F.col("doc_id").alias(x), F.col("pairs").alias(f"pairs_{x}"))
    first = F.col("pairs_a") >= F.col("pairs_b")
    turned = pairs.join(many("a"), "a").join(many("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc"), F.greatest("pairs_a", "pairs_b").alias("pairs"))
    salts = (F.col("pairs") / PAIRS).cast("int") + 1
    turned = scratch.keep(turned.select("head", "doc", F.pmod(F.xxhash64("doc"), salts).cast("int").alias("salt")), "turned")
    heads = sets.select(F.col("doc_id").alias("head"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("set").alias("set_a")).join(turned.select("head", "salt").distinct(), ["head", "salt"], "left_semi")
    rows = turned.join(sets.select(F.col("doc_id").alias("doc"), F.col("set").alias("set_b")), "doc").join(heads, ["head", "salt"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(shared * 100 >= percent * (len(x) + len(y) - shared))
            yield batch.select(["head", "doc"]).filter(pa.array(ok, pa.bool_())).rename_columns(["u", "v"])

    links = scratch.keep(rows.select("head", "doc", "set_a", "set_b").mapInArrow(verify, "u long, v long").distinct(), "links")
    scratch.drop(sets)
    return links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = FREQUENT, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.  See the module for the plan and the defined cases."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.keep(set_table(docs, words), "sets")
    total = table.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    often = scratch.keep(frequent_shingles(docs, words, total, frequent), "frequent")
    rows = (_prefix_rows_broadcast if often.count() <= broadcast_limit else _prefix_rows_join)(docs, words, percent, often)

    # groups by shingle; a frequent one in salted parts
    salts = (F.col("df") / SALT_ROWS).cast("int") + 1
    rows = rows.select("doc_id", "low", "n", "token", "pos", salts.alias("salts")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    group = Window.partitionBy("token", "salt")
    rows = rows.withColumns({"size": F.count("*").over(group), "head": F.min(F.struct("pos", "doc_id", "n")).over(group)}).where("size > 1 or salts > 1")
    rows = scratch.keep(rows.select("token", "doc_id", "low", "n", "pos", "salts", "size", "head"), "rows")
    rows = rows.select("*", F.col("head.doc_id").alias("head_doc"), F.col("head.n").alias("m"), F.col("head.pos").alias("at")).drop("head")
    heads = rows.where("salts > 1 and doc_id = head_doc")
    over = Window.partitionBy("token")
    heads = heads.withColumn("top", F.min(F.struct("pos", "doc_id", "n")).over(over)).select("doc_id", "n", "pos", F.col("top.doc_id").alias("head_doc"), F.col("top.n").alias("m"), F.col("top.pos").alias("at"))
    star = rows.select(*heads.columns).unionByName(heads).where("doc_id <> head_doc").where(_may_link(percent, "n", "pos", "m", "at"))
    pairs = scratch.keep(star.select(F.least("head_doc", "doc_id").alias("a"), F.greatest("head_doc", "doc_id").alias("b")).distinct(), "candidates")
    first = _verified(pairs, docs, table, words, percent, scratch)

    # groups that are still in several components
    parts = scratch.keep(components(first), "parts")
    rows = rows.where("size > 2 or salts > 1").select("token", "doc_id", "low", "n", "pos").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = scratch.keep(rows, "labelled")
    open_ = scratch.keep(_open_groups(rows), "groups")
    rows = scratch.keep(_with_bits(scratch.keep(rows.join(open_, "token"), "members"), table), "open")
    more = _across(rows, percent).join(pairs, ["a", "b"], "left_anti")
    second = _verified(more, docs, table, words, percent, scratch)

    classes = scratch.keep(table.where("n > 0 and doc_id is not null").groupBy("low", "high", "n").agg(F.min("doc_id").alias("node")), "classes")
    several = table.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same = table.join(several, "doc_id").join(classes, ["low", "high", "n"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    linked = components(first.unionByName(second).unionByName(same))
    classes = scratch.keep(classes.join(linked, "node", "left").select("low", "high", "n", F.coalesce("component", "node").alias("component")), "components")
    scratch.drop_but(table, classes)
    out = table.select("doc_id", "n", "low", "high").join(classes, ["low", "high", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near copies, all columns as they are: of each group of linked rows one stays.

    Every row is judged by its own text, whatever other rows its doc_id has.  The row of the smallest doc_id stays (one
    without doc_id only if no other is in the group; of equal ones the smallest hash of text).  Rows without words are in no group and stay.
    """
    scratch = Scratch(docs.sparkSession)
    row = fresh(docs, "row")
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so a row keeps its number
    own = numbered.select(F.col(row).alias("doc_id"), F.col("text"))
    groups = jaccard_components(own, words, percent).where("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    ids = numbered.select(F.col(row), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), F.col(row).alias("row")).alias("_order"))
    grouped = scratch.keep(groups.join(ids, row).select("_group", "_order"), "groups")
    first = grouped.groupBy("_group").agg(F.min("_order").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = grouped.join(first, "_group").where(F.col("_order.row") != F.col("first.row")).select(F.col("_order.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
