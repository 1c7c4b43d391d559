import zlib

import numpy as np
import pyarrow as pa

from lodestack.llm import toxicity as X


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic = [r.score for r in held if r.toxic == 1]
    clean = [r.score for r in held if r.toxic == 0]
    auc = np.mean([np.mean(np.array(clean) < s) + 0.5 * np.mean(np.array(clean) == s) for s in toxic])
    assert auc > 0.94
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.02


def test_pairs_beyond_weights():
    """A word that matters only beside another one."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.4
    y = (x[:, 0] & x[:, 1]).astype(float)
    row, feature = np.nonzero(x)
    model = X.FactorizationMachine(np.arange(6), 0.0).fit(y, row, feature)
    margin, _ = model.margin(4000, row, feature)
    assert np.mean((margin > 0) == (y == 1)) > 0.98


def test_odd_rows(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1), (77, 1)], "doc_id bigint, toxic int")
    for labels in (empty, some):
        out = X.toxicity(odd, labels).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert X.toxicity(none, labels).count() == 0
    flagged = X.flag_toxic(odd, X.train(odd, some))
    assert flagged.columns == odd.columns + ["toxic_score"] and flagged.count() == odd.count()


def strings_of(text):
    """The terms of a text, as strings: whole words, and their beginnings."""
    words, word = [], b""
    for b in (text or "").encode() + b" ":
        low = b + 32 if 65 <= b <= 90 else b
        if low >= 128 or chr(low).isalnum():
            word += bytes([low])
        else:
            words += [word] if word else []
            word = b""
    return {(0, w) for w in words} | {(1, w[:n]) for w in words for n in X.PREFIXES if len(w) >= n}


def test_terms_and_scores_by_brute_force(corpus, odd, spark):
    """Every text's terms, its margin as a sum over all pairs of them, and the choice of terms, without vectors."""
    rows = [r.text for r in odd.collect()] + [r.text for r in corpus.limit(60).collect()]
    row, term = X.hashed_terms(pa.array(rows, pa.string()))
    name = {}
    for i, text in enumerate(rows):
        mine = strings_of(text)
        assert len(term[row == i]) == len(set(term[row == i])) and len(mine) - 2 <= (row == i).sum() <= len(mine)
        for n, k in ((len(name), x) for x in mine):
            name.setdefault(k, n)
    rng = np.random.default_rng(0)
    known = np.unique(rng.choice(term, 40))
    model = X.FactorizationMachine(known, -0.3)
    model.w, model.v = rng.normal(0, 1, len(known)), rng.normal(0, 1, model.v.shape)
    got = [r.score for r in X.score(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    for i in range(len(rows)):
        at = [int(np.flatnonzero(known == t)[0]) for t in term[row == i] if t in known]
        margin = model.bias + sum(model.w[k] for k in at) + sum(float(model.v[a] @ model.v[b]) for n, a in enumerate(at) for b in at[:n])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(margin, -35, 35)))) < 1e-9


def test_chosen_terms(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.3), sorted({int(t) for t in rng.integers(0, 30, 6)})) for _ in range(200)]
    rows = [(y, sorted({*ts, 99} if y and k % 3 else set(ts))) for k, (y, ts) in enumerate(rows)]
    n, hits = len(rows), sum(y for y, _ in rows)
    want = {}
    for t in {t for _, ts in rows for t in ts}:
        df, hit = sum(t in ts for _, ts in rows), sum(y for y, ts in rows if t in ts)
        phi = (hit - hits * df / n) ** 2 / (hits / n * (1 - hits / n) * df * (1 - df / n)) / n if df < n else 0
        if df >= X.HELD and phi >= X.TELLING:
            want[t] = (phi, hit > hits * df / n)
    got = X.telling_terms(spark.createDataFrame(rows, "toxic int, terms array<int>"), 50)
    assert dict(got) == {t: s for t, (_, s) in want.items()} and got[0][0] == 99
    assert [t for t, _ in X.telling_terms(spark.createDataFrame(rows, "toxic int, terms array<int>"), 2)] == [t for t, _ in got[:2]]


def test_group_beside_insult(spark):
    """A name that is as common in clean texts is admitted for what it does beside an insult, and decides."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.3, rng.random() < 0.4
        words = [f"filler{k}" for k in rng.integers(0, 60, 12)] + ["blockhead"] * insult + ["islanders"] * group
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    y = dict(labels)
    out = X.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in out]) > 0.99
