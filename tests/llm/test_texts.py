"""Small fixtures against brute force for the text operators."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, jaccard_join, license_scan, quality_rules, sentencepiece_viterbi, substring_dedup, token_counts
from fleetlens.llm.wordhash import Words, runs

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [(None, "one two"), (900, None), (900, "one two"), (901, ""), (902, " \n\t "), (903, "one two"), (904, "ONE  two"), (905, "é 한국 🙂 don't 12½ x<|endoftext|>y"), (905, "é 한국 🙂 don't 12½ x<|endoftext|>y"), (906, "  a   b \n\n c  ")]


def table(spark, rows):
    """Documents with columns whose names clash with what operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in ("lang", "score", "hits", "n", "gone", "n_removed", "spans", "id", "token", "row")}).repartition(3)


def key(rows):
    return sorted(rows, key=str)


def test_word_hash_equals_python_words():
    texts = ["A b  c\n", "", "x", "é\x0bü a", "b c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = Words(data, offsets)
    got = [bytes(data[a:b]) for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in t.encode().split()]
    by = {}
    for word, h in zip(got, w.hash.tolist()):
        assert by.setdefault(word.lower(), h) == h
    assert len(set(by.values())) == len(by) and len(runs(w.hash, 99)) == 0


@pytest.mark.parametrize("options", [{}, {"frequent": 3}, {"frequent": 3, "broadcast_limit": 0}])
def test_jaccard_components(spark, monkeypatch, options):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 5)
    rng, rows = random.Random(7), list(ODD)
    bases = [rng.choices(WORDS, k=60) for _ in range(3)]
    for k in range(60):
        w = list(bases[k % 3])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(60)] = f"q{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if None not in (i, j) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                i, j = find(i), find(j)
                top[max(i, j)] = min(i, j)
    want = [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]
    got = [tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows), **options).collect()]
    assert key(got) == key(want)


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}])
def test_jaccard_shared_blocks(spark, options):
    """Texts made of the same few passages: groups of one membership are one, and only linked members leave them."""
    r = random.Random(4)
    blocks = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(9)]
    rows = []
    for i in range(150):
        words = " ".join(r.sample(blocks, 4)).split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"x{i}"
        rows.append((i // 2 * 2 if i % 40 == 1 else i, " ".join(words)))  # some rows repeat a doc_id
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    top = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        before = dict(top)
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(top[rows[a][0]], top[rows[b][0]])
                    top[rows[a][0]] = top[rows[b][0]] = low
        if top == before:
            break
    got = jaccard_join.jaccard_components(table(spark, rows), frequent=3, **options).collect()
    assert key(tuple(x) for x in got) == key((i, len(s), top[i]) for (i, _), s in zip(rows, sets))
    assert len(set(top.values())) not in (1, len(top))


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}])
def test_jaccard_repeated_row(spark, options):
    """A row given twice, linked at 89/111 by shingles that are all frequent; its 11 own ones come first."""
    shared = [f"w{k}" for k in range(93)]
    a, b = (" ".join([f"{x}{k}" for k in range(11)] + shared) for x in "ab")
    rows = [(1, a), (1, a), (2, b), (3, "apart")]
    got = [tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows), frequent=3, **options).collect()]
    assert key(got) == key([(1, 100, 1), (1, 100, 1), (2, 100, 1), (3, 1, 3)])


def test_jaccard_template(spark):
    """Many texts of one form and length that share most shingles but do not link, and linked ones among them."""
    rows = [(k, f"we could not find the page you asked for k{k}") for k in range(400)]
    long = [f"w{k}" for k in range(40)]
    rows += [(1000 + k, " ".join(long[: 40 - k % 4] + ["tail"] * 1)) for k in range(12)]
    rows += [(2000, rows[5][1]), (2001, rows[7][1].upper())]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table(spark, rows), frequent=3).collect()}
    assert got[2000] == 5 and got[2001] == 7 and all(got[k] == k for k in range(400))
    assert {got[1000 + k] for k in range(12)} == {1000}


def test_without_near_copies(spark):
    """Rows are judged one by one: of a group one row stays, whatever else its doc_id has."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = a + " more"
    rows = [(7, a), (7, b), (8, c), (8, near), (None, b), (None, "only here " * 9), (9, c), (9, c), (10, ""), (10, None), (10, "")]
    docs = table(spark, rows)
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    want = [(7, a), (7, b), (8, c), (None, "only here " * 9), (10, ""), (10, None), (10, "")]
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(want)
    assert jaccard_join.without_near_copies(docs.limit(0)).collect() == []


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(table(spark, ODD).limit(0)).collect() == []


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.describe(path)["type"] == "ByteLevel"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:60] + ODD + [(907, "a" * 5000), (908, "\u00a0 x\u2003y \u0b83z\u00b2 ~~  !! 's'S")]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows]
    for head in (0, 300, 1 << 18):
        assert key(tuple(r) for r in token_counts.token_counts(table(spark, rows), path, head=head).collect()) == key(want)
    assert token_counts.token_counts(table(spark, rows).limit(0), path).collect() == []


def test_pattern_classes_equal_library():
    """Every character of the basic plane falls into the same kind of pre-token as in the library."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    differ = []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        text = f"a{c}1{c}!{c} {c}b"
        mine = token_counts._pretokens(text)
        spans = [s for _, s in split.pre_tokenize_str(text)]
        if [text[a:b] for a, b in spans] != mine:
            differ.append(c)
    assert differ == []


def naive_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)})


def test_quality_rules_base(spark):
    rng = random.Random(1)
    rows = [*ODD, (1, "a b c a b c a b"), (2, "x " * 300), (3, " ".join(rng.choices("a b c d e f".split(), k=200))), (4, " ".join(f"w{k % 90}" for k in range(300))), (5, "dup\ndup\n\n\n##$ %\ndup  \n *"), (6, "a b c"), (7, "a a a a")]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = naive_repeats(w)
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)))
    assert got == want
    assert quality_rules.quality_rules(table(spark, rows).limit(0)).collect() == []


def test_quality_rules_verdict(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    r = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    kept = {x.quality: x.k for x in r}
    assert kept[1] > 0.98 and kept.get(0, 0) < 0.6


def test_js_distance_bounds(spark):
    d = lambda p, q: spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first().d
    assert abs(d([1.0, 0.0], [0.0, 1.0]) - 1) < 1e-12 and d([0.5, 0.5], [0.5, 0.5]) == 0


def test_license_scan(spark):
    rows = [*ODD, (1, "x\nLicensed under the Apache License, Version 2.0."), (2, "CC-BY cc by and ALL rights  reserved"), (3, "permission is hereby granted, free of any charge to any person obtaining a copy of this nice software and associated documentation files"), (4, "the general public license general public license"), (4, "the general public license general public license")]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert len(got) < len(rows)
    assert got[1].labels == "apache-2.0" and got[1].base_labels == "" and got[1].score == 1.0
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert got[3].labels == "mit" and 0.7 <= got[3].score <= 1 and got[3].spans[0].first_word == 0
    assert (got[4].n_base, got[4].labels) == (2, "gpl")
    assert got[902].n_words == 0 and got[902].labels == "" and got[902].score == 0 and got[902].first_word is None
    assert license_scan.license_scan(table(spark, rows).limit(0)).collect() == []


def naive_spans(rows, k=substring_dedup.SENTENCES, least=substring_dedup.WORDS):
    """Sentences without long ones: same rule by plain strings."""
    cut = {i: [s for s in re.split(r"(?<=[.!?])(?=\s)|(?<=\n)", t) if s] for i, t in rows}
    where = {}
    for i in sorted(cut):
        for at in range(len(cut[i])):
            if not cut[i][at].split():
                continue
            for end in range(at + 1, len(cut[i]) + 1):
                part = [s.lower().split() for s in cut[i][at:end]]
                if sum(map(bool, part)) >= k and sum(map(len, part)) >= least:
                    where.setdefault(tuple(w for p in part for w in p), []).append((i, at, end))
                    break
    drop = {(i, j) for places in where.values() for i, at, end in sorted(places)[1:] for j in range(at, end)}
    return {i: "".join(s for j, s in enumerate(cut[i]) if (i, j) not in drop) for i in cut}


def test_substring_dedup_against_strings(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(3, 12))).capitalize() + rng.choice([".", "!", "?", ".\n"])
    shared = [[sentence() for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(25):
        parts = [sentence() for _ in range(5)]
        for s in rng.sample(shared, rng.randrange(3)):
            parts[2:2] = s
        rows.append((i, " ".join(parts)))
    rows += [(30, rows[0][1]), (31, "Hey! " * 40)]
    out = substring_dedup.substring_dedup(table(spark, rows + [(None, rows[0][1]), (40, None), (41, "")]))
    assert out.columns[-2:] == ["n_sentences", "_n_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    want = naive_spans(rows)
    assert {i: got[i] for i in want} == want
    assert got[None] == rows[0][1] and got[40] is None and got[41] == ""


def test_substring_dedup_long_and_empty(spark):
    rng = random.Random(12)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(120_000))
    rows = [(1, long), (2, "Before. " + long[600_000:601_000] + " After."), (3, None)]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == long and len(got[2]) < 200 and got[2].startswith("Before.") and got[3] is None
    assert substring_dedup.substring_dedup(table(spark, rows).limit(0)).collect() == []


def test_substring_dedup_unpunctuated_passage(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(99))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40))) for i in range(3)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(len(got[i].text.split()) < 140 for i in (1, 2))


@pytest.mark.parametrize("ends", [0, 9, 20])
def test_substring_dedup_any_51_words(spark, ends):
    """Passages of 51 words that neither start nor end at sentence ends; about one word in ``ends`` ends a sentence."""
    rng, rows = random.Random(51 + ends), []
    for k in range(300):
        word = lambda: rng.choice(WORDS) + str(rng.randrange(9999)) + ("." if ends and rng.randrange(ends) == 0 else "")
        passage = [word() for _ in range(51)]
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join([*(word() for _ in range(rng.randrange(60))), *passage, *(word() for _ in range(rng.randrange(60)))])))
    got = {r.doc_id: r.text.split() for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    gone = [len(rows[i][1].split()) - len(got[i]) for i in range(600)]
    assert not any(gone[::2]) and max(gone) <= 51 and min(gone[1::2]) >= 15
    assert sum(gone[1::2]) >= (0.7 if ends else 0.8) * 300 * 51
    for i in range(1, 600, 2):  # what goes is in the passage, so it is in the other document
        kept = [w for w in rows[i][1].split() if w not in set(got[i])]
        assert set(kept) <= set(rows[i - 1][1].split())


def naive_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != x), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_decontamination_against_table(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, prose(30)) for i in range(6)] + [(6, None), (7, "tiny")]

    def damaged(t, n):
        t = list(t)
        for _ in range(n):
            at = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(at, "#"), lambda: t.pop(at), lambda: t.insert(at, "%")])()
        return "".join(t)

    rows = [(i, prose(50) + " " + damaged(items[i % 6][1], rng.choice([0, 2, 5, 10, 13, 16, 25])).upper().replace(" ", "  ") + "\n" + prose(40)) for i in range(30)] + ODD
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.benchmark_hits(table(spark, rows), benchmark).collect()}
    want = set()
    for i, t in rows:
        for k, item in items[:6]:
            d = naive_distance(decontaminate.normal(item), decontaminate.normal(t))
            if d <= int(decontaminate.RATE * len(item)):
                want.add((i, k, d))
    assert got == want and want
    clean = decontaminate.decontaminated(table(spark, rows), benchmark)
    assert clean.columns == table(spark, rows).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _, _ in want}
    assert decontaminate.benchmark_hits(table(spark, rows), benchmark.limit(0)).count() == 0


def test_decontamination_short_items(spark):
    """Items under 40 characters are found word for word, between word bounds."""
    items = [(1, "What is  Rho?"), (2, "rho"), (3, " "), (4, "水是什么"), (5, "C++"), (6, "alpha beta gamma delta epsilon zeta eta theta")]
    rows = [(1, "Say: what is\nrho? yes"), (2, "rhombus arrho rho_ what is rhò?"), (3, "a rhombus and (RHO)"), (4, "请问水是什么呢"), (5, "what is rha?"), (6, "objc++ or c++11"), (7, "alpha beta gamma delta epsilon zeta eta thetas"), (8, None), (8, "c++")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.benchmark_hits(table(spark, rows), benchmark).collect()]
    assert key(got) == key([(1, 1, 0, 5, 17), (1, 2, 0, 13, 16), (3, 2, 0, 15, 18), (4, 4, 0, 2, 6), (6, 5, 0, 10, 13), (7, 6, 0, 0, 45), (8, 5, 0, 0, 3)])
    assert {r.doc_id for r in decontaminate.decontaminated(table(spark, rows), benchmark).collect()} == {2, 5, 8}


def test_decontamination_spans(spark):
    """The passage found is as far from the item as its distance says, wherever edits stand."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=14))) for i in range(5)]
    rows = []
    for i in range(40):
        t = list(items[i % 5][1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        rows.append((i, "omega psi " * rng.randrange(3) + "".join(t) + " chi" * rng.randrange(3)))
    got = decontaminate.benchmark_hits(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) >= 35
    for r in got:
        passage, item = decontaminate.normal(rows[r.doc_id][1])[r["first"] : r.end], items[r.item_id][1]
        before = list(range(len(passage) + 1))
        for i, c in enumerate(item, 1):
            now = [i]
            for j, x in enumerate(passage, 1):
                now.append(min(before[j - 1] + (c != x), before[j] + 1, now[j - 1] + 1))
            before = now
        assert before[-1] == r.distance


def test_decontamination_long_and_empty(spark):
    """A piece that repeats all through a long text is no burden; tables without rows give none."""
    item = "na " * 40 + "hey jude do not make it bad"
    rows = [(1, "na " * 60_000), (2, "na " * 60_000 + "hey jude do not make it bad"), (3, None)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [(r.doc_id, r.distance) for r in decontaminate.benchmark_hits(table(spark, rows), benchmark).collect()]
    assert got == [(2, 0)]
    assert decontaminate.benchmark_hits(table(spark, rows).limit(0), benchmark).collect() == []
    assert decontaminate.decontaminated(table(spark, rows).limit(0), benchmark).collect() == []


def test_decontaminated_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(8)]
    rows = [(i, items[i % 8][1] if i % 3 else " ".join(rng.choices(WORDS, k=20))) for i in range(24)]
    kept = decontaminate.decontaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(24) if i % 3 == 0} and kept.columns == table(spark, rows).columns


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(8)]
    rows = [(i, items[i][1] + " " + items[(i + 1) % 8][1]) for i in range(8)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, j % 8) for i in range(8) for j in (i, i + 1)}


def test_sentencepiece(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_viterbi.pieces(path)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # the library adds in single precision, where the space runs' scores of -1e9 swallow the others
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    total = lambda ids: sum(model.score[k] for k in ids)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:40]
    for w in {w for t in texts for w in t.split()}:
        mine, theirs = model.encode(w), library.encode(w)
        assert mine == theirs or total(mine) == total(theirs), w

    def brute(part):
        n, score = len(part), {p: s for p, s in zip(library.id_to_piece(list(range(len(model.score)))), model.score)}
        best = [0.0] + [-np.inf] * n
        for j in range(1, n + 1):
            best[j] = max([best[i] + score[part[i:j]] for i in range(max(0, j - 16), j) if part[i:j] in score] + [best[j - 1] + model.unknown])
        return best[n]

    for w in ["hello", "né🙂x", "\n\ta", "▁▁▁x", "internationalization"]:
        part = sentencepiece_viterbi.MARK + w
        unknown = sum(c not in library.id_to_piece(list(range(32000))) for c in part)
        if not unknown:
            assert total(model.viterbi(part)) == brute(part)
    rows = [*ODD, *enumerate(texts), (950, " lead"), (951, "trail "), (952, "a ▁ b"), (953, "\ud7ff\x00\x01")]
    got = sentencepiece_viterbi.encode(table(spark, rows), path).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(table(spark, [x for x in rows if x[0] and x[0] > 905 and x[1]]), path), path).collect()}
    assert back[950] == " lead" and back[952] == "a   b" and back[906] == "  a   b \n\n c  "


def test_sentencepiece_long_and_empty(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "supercalifragilistic" * 20_000), (2, "word " * 50_000), (3, None)]
    got = {r.doc_id: r for r in sentencepiece_viterbi.encode(table(spark, rows), path).collect()}
    assert all(r.round_trip for r in got.values()) and got[3].n_pieces == 0
    assert sentencepiece_viterbi.encode(table(spark, rows).limit(0), path).collect() == []


def test_license_scan_long_text(spark):
    filler = "lorem ipsum " * 40_000
    rows = [(1, filler + "all rights reserved " + filler), (2, "the licence: released under the \u212aey; Released Under The MIT License " + filler)]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].n_words) == (1, 80_000, 160_003)
    assert got[2].labels == "mit"
    assert license_scan.license_scan(table(spark, rows).limit(0)).collect() == []
