"""Texts that repeat notices many times."""

import time

from fleetlens.llm import license_scan

LONG = ("one", "alpha beta gamma delta epsilon zeta eta theta iota kappa")
INNER = ("two", "gamma delta epsilon zeta")


def spans(spark, n):
    text = " ".join([f"{LONG[1]} x{k} y{k}" for k in range(n)])
    rows = spark.createDataFrame([(1, text), (2, f"u {INNER[1]} v"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in license_scan.license_scan(rows, templates=(LONG, INNER)).collect()}
    return got, time.time() - began


def test_every_repeat_is_a_span_and_what_lies_in_it_goes(spark):
    got, _ = spans(spark, 400)
    assert [(s.first_word, s.last_word, s.label) for s in got[1].spans] == [(12 * k, 12 * k + 9, "one") for k in range(400)]
    assert got[1].labels == "one" and got[2].labels == "two" and [(s.first_word, s.last_word) for s in got[2].spans] == [(1, 4)]
    assert got[3].labels == "" and got[3].n_words == 0


def test_work_grows_with_the_spans(spark):
    spans(spark, 10)
    few, many = spans(spark, 2000)[1], spans(spark, 16000)[1]
    assert many < 8 * few + 10
