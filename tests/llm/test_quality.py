import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import quality as Q


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            again |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(again)


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_statistics(request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in Q.text_statistics(df, "doc_id").select("doc_id", *Q.COUNTS[:5]).collect()), key=str)
    assert got == sorted(((r.doc_id, *counts(r.text)) for r in df.collect()), key=str)


def test_verdicts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Q.quality(docs, labels).join(labels, "doc_id")
    table = {(r.kept, r.quality): r["count"] for r in out.groupBy("kept", "quality").count().collect()}
    bad, good = table.get((False, 0), 0), table.get((True, 1), 0)
    assert bad / (bad + table.get((True, 0), 0)) > 0.9 and good / (good + table.get((False, 1), 0)) > 0.97


def test_no_labels(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out = Q.quality(odd, labels)
    assert out.where(F.col("kept") == F.col("base_failed")).count() == 0 and out.count() == odd.count()
    assert Q.quality(none, labels).count() == 0


def test_list_is_ordered_and_precise():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in Q.FEATURES}
    bad = ((x["symbol_share"] > 0.8) & (x["n_words"] < 0.5)) | (x["upper_share"] > 0.95)
    rules = Q.learn(x, bad)
    covered = np.zeros(3000, bool)
    for r in rules.rules:
        covered |= rules.covers(r, x)
    assert rules.rules and (covered & bad).sum() > 0.9 * bad.sum() and (covered & ~bad).sum() < 0.05 * bad.sum()


def test_verdict_by_brute_force(spark, corpus):
    """kept follows from the counts by the rules as they read, one text at a time."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = Q.train(docs, labels)
    assert rules.rules
    python = {f: compile(re.sub(r"greatest\((\w+), 1\)", r"max(\1, 1)", e), f, "eval") for f, e in Q.FEATURES.items()}
    out = Q.text_statistics(corpus, "doc_id").withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    rejected = 0
    for r in out.withColumn("kept", ~F.col("base_failed") & rules.expression()).collect():
        x = {f: float(eval(code, {"max": max}, r.asDict())) for f, code in python.items()}
        bad = any(all(x[f] >= t if at_least else x[f] < t for f, at_least, t in rule) for rule in rules.rules)
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (r.base_failed, r.kept) == (base, not base and not bad)
        rejected += bad
    assert rejected


def test_lines_of_equal_polynomials(spark):
    """Two lines whose fingerprints agree modulo any power of two are no repeats of each other."""
    line = "a"
    while len(line) < 1024:
        line += line.translate({97: "b", 98: "a"})
    text = line + "\n" + line.translate({97: "b", 98: "a"}) + "\n" + line
    got = Q.text_statistics(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id").first()
    assert got.n_dup_lines == 1 and (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == counts(text)
