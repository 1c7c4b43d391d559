import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing as M


def wanted(sizes):
    """Targets by resharing until none is above its stop."""
    sources = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sources), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        for s in over or list(open_):
            out[s] = 2.0 * sizes[s] if over else share * weight[s]
            left -= out[s]
            open_.remove(s)
    return out


def keyed(df):
    return M.sized(df.select("doc_id", "text", "source")).selectExpr("doc_id", "source", "size", "0L as key")


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_balance(request, name):
    df = request.getfixturevalue(name)
    rows = M.mix(keyed(df)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode().split())) for r in df.collect())
    assert Counter((r.doc_id, r.size) for r in rows) == want
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in wanted(sizes).items():
        assert math.isclose(target[s], t, abs_tol=1e-6) and abs(taken[s] - t) <= 0.5 + 1e-6, s


def multiplier(sizes, target):
    """The dual by bisection: rates min(2, exp(m s / scale)) that take target words."""
    scale = sum(s * s for s in sizes) / sum(sizes)
    lo, hi = -2000.0, 2000.0
    for _ in range(200):
        m = (lo + hi) / 2
        if sum(s * min(2.0, math.exp(min(700.0, m * s / scale))) for s in sizes) > target:
            hi = m
        else:
            lo = m
    return m, scale


def test_dual(corpus, spark):
    """Rates tilt by document: those of one source follow from one multiplier, found by brute force here."""
    rows = M.mix(keyed(corpus)).collect()
    lumpy = [(i, "ab"[i % 2], 1 + (i * i) % 37 + 4000 * (i % 29 == 0), 0) for i in range(300)]
    rows += M.mix(spark.createDataFrame(lumpy, "doc_id bigint, source string, size bigint, key bigint").withColumn("source", F.concat(F.lit("x"), "source"))).collect()
    tilted = 0
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source and r.size]
        if mine[0].target >= 2 * mine[0].source_size:
            assert all(r.rate == 2 for r in mine)
            continue
        m, scale = multiplier([r.size for r in mine], mine[0].target)
        assert all(abs(r.rate - min(2.0, math.exp(m * r.size / scale))) < 1e-5 for r in mine)
        assert abs(sum(r.copies for r in mine) - sum(r.rate for r in mine)) < 1
        tilted += len({round(r.rate, 6) for r in mine}) > 1
    assert tilted >= 2


def test_most_copies_are_whole(corpus):
    rows = M.mix(keyed(corpus)).collect()
    assert sum(r.taken != r.copies * r.size for r in rows) < 0.2 * len(rows)


def test_documents(odd, none, corpus):
    for df in (odd, none, corpus):
        want = {}
        for r in M.balance(df).collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
        out = M.mixed_documents(df)
        assert out.columns == df.columns
        got = defaultdict(int)
        for r in out.collect():
            got[r.doc_id] += len(r.text.encode().split())
        assert dict(got) == {k: v for k, v in want.items() if v}
