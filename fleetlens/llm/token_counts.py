"""Operator 4: token counts without token ids.

Byte-level BPE merges never cross a pre-token, so a text's length in tokens is the sum,
over its pre-tokens, of the pieces of each.  The job

1. counts the distinct pre-tokens of the corpus (combined in the task, then by Spark),
2. lets the tokenizer library encode every distinct pre-token once,
3. sends the most frequent ones (``head`` entries, those of over ``HEAD_CHARS`` characters by their
   SHA-256: a fixed bound) to all tasks, which sum them up while they read the texts, and
4. joins the remaining (row, pre-token, frequency) rows to the table of counts.

Null text counts as empty: 0 bytes, 0 tokens.  Rows with a null or repeated ``doc_id`` stay
separate rows.  No table column but ``doc_id`` and ``text`` is read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, text_of

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = 1 << 18
HEAD_CHARS = 64
#: Entries of a task's dictionaries before they are emptied.
CACHE = 400_000

#: Letters and numbers of later Unicode versions, which are neither in the library's tables (hexadecimal ranges).
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_later = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
_ascii = regex.compile(PATTERN).findall
_whole = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[@])").replace(r"\p{L}+", r"[\p{L}--[@]]+").replace(r"\p{N}+", r"[\p{N}--[@]]+").replace("@", _later), regex.V1).findall


def _pretokens(text: str) -> list[str]:
    return _ascii(text) if text.isascii() else _whole(text)


_odd_space = regex.compile(r" (?:\s|$)").search


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Added tokens, longest first: the library takes them out of a text before it is pre-tokenized."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    return tuple(sorted((t.content for t in added), key=len, reverse=True))


def _chunks(text: str) -> tuple[list[str], list[str]]:
    """Two lists of pieces of a text that begin and end where a pre-token does; a space belongs before each of the second.

    A single space before a visible character always opens a pre-token, so a text whose
    spaces are all of that kind is cut at them; any other is cut into its pre-tokens.
    """
    if _odd_space(text):
        return _pretokens(text), []
    first, *rest = text.split(" ")
    return ([first] if first else []), rest


def _plain(text: str, special) -> tuple[int, list[str]]:
    """Occurrences of special strings, and the text between them."""
    return (0, [text]) if special is None or special.search(text) is None else (len(special.findall(text)), special.split(text))


def _special_pattern(path: str):
    found = special_strings(path)
    return regex.compile("|".join(regex.escape(x) for x in found)) if found else None


def _split_units(whole: Counter, spaced: Counter) -> Counter:
    out: Counter = Counter()
    for before, units in (("", whole), (" ", spaced)):
        for unit, n in units.items():
            for p in _pretokens(before + unit):
                out[p] += n
    return out


def pretoken_counts(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, n): every distinct pre-token of the corpus with its frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Counter = Counter()
        spaced: Counter = Counter()
        special = _special_pattern(path)

        def flush():
            found = _split_units(whole, spaced)
            whole.clear()
            spaced.clear()
            return pa.RecordBatch.from_pydict({"pretoken": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for value in batch.column(0):
                for part in _plain(value.as_py() or "", special)[1]:
                    first, rest = _chunks(part)
                    whole.update(first)
                    spaced.update(rest)
                if len(whole) + len(spaced) > CACHE:
                    yield flush()
        if whole or spaced:
            yield flush()

    return text_of(docs, "text").mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``: the length of each pre-token in tokens, as the library gives it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        for batch in batches:
            texts = batch.column("pretoken").to_pylist()
            lengths: list[int] = []
            for i in range(0, len(texts), 2000):
                lengths += [len(e) for e in library.encode_batch(texts[i : i + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array(lengths, pa.int32())], ["pretoken", "n", "pieces"])

    return pretokens.select("pretoken", "n").mapInArrow(encode, "pretoken string, n long, pieces int")


def _key(pretoken: str) -> str:
    """What stands for a long pre-token in the head."""
    return "\0" + hashlib.sha256(pretoken.encode("utf-8", "surrogatepass")).hexdigest()


def _head(vocabulary: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, ``most`` at most: whole classes of frequency (eighths of a power of two), from the top."""
    short = F.when(F.char_length("pretoken") <= HEAD_CHARS, F.col("pretoken")).otherwise(F.concat(F.lit("\0"), F.sha2("pretoken", 256)))
    classed = vocabulary.select(short.alias("key"), "pieces", F.floor(F.log2("n") * 8).alias("class"))
    least, total = None, 0
    for r in classed.groupBy("class").count().orderBy(F.desc("class")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["class"]
    return {} if least is None else {r.key: r.pieces for r in classed.where(F.col("class") >= least).select("key", "pieces").collect()}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).  See the module for the defined cases."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocabulary = scratch.keep(piece_counts(pretoken_counts(docs, path), path), "pretokens")
    known = spark.sparkContext.broadcast(_head(vocabulary, head))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        pieces, special = known.value, _special_pattern(path)
        caches: tuple[dict, dict] = ({}, {})
        for batch in batches:
            n_bytes, head_tokens, ends, names, freqs = [], [], [0], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                tokens, parts = _plain(text, special)
                tail: Counter = Counter()
                for part in parts:
                    for units, before, cache in zip(_chunks(part), ("", " "), caches):
                        for unit, n in Counter(units).items():
                            if (found := cache.get(unit)) is None:
                                each = _pretokens(before + unit)
                                keys = [p if len(p) <= HEAD_CHARS else _key(p) for p in each]
                                found = cache[unit] = (sum(pieces.get(k, 0) for k in keys), tuple(p for p, k in zip(each, keys) if k not in pieces))
                            tokens += n * found[0]
                            for p in found[1]:
                                tail[p] += n
                for cache in caches:
                    if len(cache) > CACHE:
                        cache.clear()
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                head_tokens.append(tokens)
                names += tail
                freqs += tail.values()
                ends.append(len(names))
            each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(freqs, pa.int64())], ["pretoken", "n"])
            rows = pa.array(range(row, row + len(n_bytes)), pa.int64())
            row += len(n_bytes)
            columns = [rows, batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(head_tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "head_tokens", "tail"])

    schema = "row long, doc_id long, n_bytes long, head_tokens long, tail array<struct<pretoken:string,n:long>>"
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, schema), "rows")
    tail = rows.select("row", F.inline("tail")).join(vocabulary.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("tail_tokens"))
    tokens = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return rows.drop("tail").join(tail, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))


def describe(path: str) -> dict:
    """The library's own settings, for a check that the pattern above is the one in the file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["pre_tokenizer"]
