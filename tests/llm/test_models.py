"""The trained operators and the pipeline."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import crf, graph, membership, quality_classifier, toxicity, url_filter

DATA = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    u, theta, starts = rng.normal(size=30) * 2, rng.normal(size=4), np.array([0, 7, 8, 20])
    p, expected = crf.marginals(u, starts, theta, pairs=True)
    t = np.exp(theta)
    a = np.array([[1, t[0]], [t[1], t[2]]])
    seen = np.zeros(4)
    for s, e in zip(starts, [*starts[1:], 30]):
        total, m, x = 0.0, np.zeros(e - s), np.zeros(4)
        for y in itertools.product([0, 1], repeat=int(e - s)):
            w = (t[3] if y[0] else 1.0) * np.exp(u[s:e][np.array(y) == 1].sum()) * np.prod([a[i, j] for i, j in zip(y, y[1:])])
            total += w
            m += w * np.array(y)
            x += w * np.array([sum(z == q for z in zip(y, y[1:])) for q in ((0, 1), (1, 0), (1, 1))] + [y[0]])
        assert np.allclose(m / total, p[s:e])
        seen += x / total
    assert np.allclose(seen, expected)
    assert len(crf.marginals(np.zeros(0), np.zeros(0, int), theta)) == 0


def _auc(pos, neg):
    return (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    some = docs.join(labels, "doc_id", "left_semi")
    r = toxicity.toxicity(some, labels).join(labels, "doc_id").select("held_out", "score", "toxic").where("held_out").collect()
    pos, neg = (np.array([x.score for x in r if x.toxic == k]) for k in (1, 0))
    assert _auc(pos, neg) > 0.93 and (neg >= toxicity.LEAST).mean() < 0.02 and (pos >= toxicity.LEAST).mean() > 0.8


def test_toxicity_spans_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    extra = spark.createDataFrame([(None, "é idiot, ok"), (9001, None), (9001, ""), (9002, " \n")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).withColumns({"score": F.lit("own"), "spans": F.lit(1), "toxic": F.lit(3)})
    got = toxicity.toxicity(both, labels).where("doc_id is null or doc_id > 9000").collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    first = next(r for r in got if r.doc_id is None)
    assert not first.held_out and [(s.first, s.end) for s in first.spans] == [(2, 7)]
    kept = toxicity.without_toxic(both, labels)
    assert kept.columns == both.columns and kept.where("doc_id = 9001").count() == 2
    none = toxicity.toxicity(both, labels.limit(0)).where("score <> 0.5").count()
    assert none == 0 and toxicity.toxicity(both.limit(0), labels).count() == 0


def test_labels_leave_held_out_rows_alone(spark):
    """Labels of held-out rows change nothing."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs.where("doc_id < 200"), x).orderBy("doc_id").select("score").collect() for x in (labels, flipped))
    assert a == b


def test_weak_labels_recover_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85]
    votes = np.array([[0 if rng.random() < 0.2 else (1 if (rng.random() < a) == t else -1) for a in accuracy] for t in y])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, rates, good = quality_classifier.estimate([(tuple(p), int(k)) for p, k in zip(patterns.tolist(), n)])
    assert abs(prior - 0.7) < 0.05
    found = rates[1, :, 2] / (rates[1, :, 2] + rates[1, :, 0])
    assert np.allclose(found, accuracy, atol=0.05)


def test_quality_scores(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    extra = spark.createDataFrame([(None, "a b"), (9001, None), (9002, "")], "doc_id long, text string").withColumn("posterior", F.lit("own"))
    both = docs.select("doc_id", "text", F.lit("own").alias("posterior")).unionByName(extra)
    out = quality_classifier.quality_scores(both).checkpoint()
    assert out.count() == docs.count() + 3 and out.where("score is null or score < 0 or score > 1").count() == 0
    keep = {r.quality: r.k for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert keep[1] > 0.98 and keep[0] < 0.2
    assert quality_classifier.quality_scores(both.limit(0)).count() == 0


def test_url_filter(spark):
    rows = [(1, None), (2, "foo"), (3, "HTTP://ÀB.Example.ORG/es/"), (4, "x://org"), (5, "a://b://c/d?x"), (6, "http://spam-farm.shop.net/en/1"), (7, "http://library.town.net/en/1"), (8, "https://example.org/en/19"), (9, "https://notexample.org/en/19"), (9, "https://notexample.org/en/19"), (None, "http://a.com/de/#x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("own"), "label": F.lit(1)})
    got = url_filter.url_filter(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None) and by[5].host == "b:" and by[5].path == "//c/d"
    assert (by[3].host, by[3].rule, by[3].verdict) == ("Àb.example.org", "example.org/es/", "block")
    assert by[4].rule is None and by[4].path == "" and by[6].verdict == "block" and by[7].verdict == "allow"
    assert by[8].rule == "example.org/en/1" and by[9].rule == "org/" and (by[None].rule, by[None].verdict) == ("com/de/", "block")


def test_url_filter_on_held_out_words(spark):
    """Each fifth of the words is judged by a model of the other four."""
    caught = wrong = missed = 0
    for fold in range(5):
        side = lambda inside, fold=fold: {k: [w for i, w in enumerate(v) if (i % 5 == fold) == inside] for k, v in url_filter.WORDS.items()}
        rows = url_filter.labelled_urls(side(True))
        pages = spark.createDataFrame([(k, u) for k, (_, u) in enumerate(rows)], "page_id long, url string")
        labelled = spark.createDataFrame(url_filter.labelled_urls(side(False)), "label int, url string")
        for r in url_filter.url_filter(pages, (), labelled).collect():
            label, blocked = rows[r.page_id][0], r.verdict == "block"
            caught, wrong, missed = caught + (label and blocked), wrong + (blocked and not label), missed + (label and not blocked)
    print("precision", caught / (caught + wrong), "recall", caught / (caught + missed))
    assert caught / (caught + wrong) >= 0.8 and caught / (caught + missed) >= 0.7


def test_url_table_has_no_host_of_the_pages(spark):
    """No word of the table is a host of the given pages; hosts of no meaning are not blocked, those of two words of spam are."""
    words = {w for own in url_filter.WORDS.values() for w in own}
    assert len(words) == sum(map(len, url_filter.WORDS.values())) > 400
    got = url_filter.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), rules=()).select("host", "verdict").collect()
    assert not words & {label for r in got for label in r.host.split(".")[:-2]}
    plain = [r.verdict == "block" for r in got if "-" not in r.host]
    spam = [r.verdict == "block" for r in got if "-" in r.host]
    assert sum(plain) < 0.05 * len(plain) and sum(spam) > 0.9 * len(spam)


def naive_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def test_url_rules_over_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, "x" * 300_000 + "://Y.ORG/" + "z" * 300_000), (-3, ""), (-4, "a://b\n.org/c\n#d")], "page_id long, url string")
    pages = pages.select("page_id", "url").unionByName(odd)
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    assert got.keys() == urls.keys()
    for i, url in urls.items():
        host, path = naive_url(url)
        fits = []
        for verdict, rule in url_filter.RULES:
            own, start = rule.split("/", 1)
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
        rule, verdict = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_filter.url_filter(pages.limit(0)).collect() == []


def test_url_labels_from_a_table(spark):
    table = spark.createDataFrame([(1, "http://qq.zz/"), (0, "http://mm.zz/"), (None, "http://x/"), (1, None)], "label int, url string")
    got = url_filter.url_filter(spark.createDataFrame([(1, "http://qq.zz/"), (2, "http://mm.zz/")], "page_id long, url string"), labelled=table).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


def test_scorer_against_loops():
    """Training of the hashed scorer against plain loops over dictionaries."""
    rng = np.random.default_rng(3)
    rows = [(float(rng.random() < 0.5), int(rng.integers(1, 4)), rng.integers(0, 50, (int(rng.integers(0, 9)), 3)).astype(np.int32)) for _ in range(30)]
    got = quality_classifier.train(rows, rounds=7)
    total = sum(k for _, k, _ in rows)
    w, seen = {}, {}
    for _ in range(7):
        g = {}
        for y, k, f in rows:
            size = ("size", int(np.log2(len(f) + 1)))
            z = 10 * sum(w.get(int(x), 0.0) for x in f.ravel()) / max(len(f), 1) + w.get(size, 0.0)
            error = k * len(rows) / total * (y - 1 / (1 + np.exp(-z)))
            g[size] = g.get(size, 0.0) + error
            for x in f.ravel():
                g[int(x)] = g.get(int(x), 0.0) + 10 * error / len(f)
        for x, v in g.items():
            v -= 1e-4 * len(rows) * w.get(x, 0.0)
            seen[x] = seen.get(x, 1e-6) + v * v
            w[x] = w.get(x, 0.0) + 0.5 * v / np.sqrt(seen[x])
    for x, v in w.items():
        at = quality_classifier.SIZE + x[1] if isinstance(x, tuple) else x
        assert abs(got[at] - v) < 1e-4 * max(1, abs(v))


def test_training_samples_are_bounded(spark, monkeypatch):
    """One text that a third of all rows have is one row of the sample; long texts count against the bytes."""
    from fleetlens.llm.shared import bounded

    df = spark.createDataFrame([(k, k % 5 * 10) for k in range(20)], "key long, size long")
    kept = [(r.key, r["size"]) for r in bounded(df, "key", "size", 6, 70).orderBy("key").collect()]
    assert kept == [(0, 0), (1, 10), (2, 20), (3, 30), (5, 0), (6, 10)]
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    many = docs.unionByName(spark.createDataFrame([(int(r.doc_id), "one and the same " * 400) for r in labels.limit(1).collect()] * 500, "doc_id long, text string"))
    sample, _ = toxicity._sample(many, labels, 50)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 100
    long = docs.unionByName(spark.createDataFrame([(-5, "long words here " * 30_000)], "doc_id long, text string"))
    assert quality_classifier.quality_scores(long).where("doc_id = -5 and score between 0 and 1").count() == 1
    assert toxicity.toxicity(long, labels).where("doc_id = -5 and score between 0 and 1").count() == 1


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, x) for x in range(301, 340)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in top}


def test_membership(spark):
    bits = membership.build(spark.range(0, 5000, 5), "id").value
    got = membership.maybe(bits, np.arange(5000))
    assert got[::5].all() and got.sum() < 1010


def test_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay, and every stage but the last returns the columns of documents."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    clean = "Ferrets groom quietly beneath ancient oak trees. Every traveller remembers some orange lantern swinging at dusk."
    rows = [(90001, clean), (90002, clean + " Extra"), (90003, "Before it. " + item + " After it."), (90004, "What an idiot, a moron, trash and scum. " + "Plain words follow here in a row. " * 2)]
    extra = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], docs.schema)
    out = docs.where("doc_id < 300").unionByName(extra)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, DATA).write.parquet(path := f"file://{tmp_path}/{k}")
        out = spark.read.parquet(path)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if k < 4:
            assert out.columns == docs.columns, name
        assert (90004 in ids) == (k < 0) and (90002 in ids) == (k < 1) and 90001 in ids and (90003 in ids) == (k < 3), name
    assert out.columns == ["doc_id", "n_pieces", "ids"]
