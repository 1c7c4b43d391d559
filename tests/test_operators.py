"""Operators against small hand-made tables and plain Python forms."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import clustering as C
from lodestack.operators import collection as A
from lodestack.operators import complexity as X
from lodestack.operators import compression as Z
from lodestack.operators import fmf
from lodestack.operators import index as I
from lodestack.operators import search as J
from lodestack.session import dense_ids

DOCS = [
    (0, "The cat sat. A dog, the DOG!"), (1, "dog and bird"), (2, ""), (3, None), (4, "Straße STRASSE ΣΊΣΥΦΟΣ σίσυφος"),
    (5, "cat dog bird fish"), (6, "fish"), (None, "lost cat"), (7, "cat " * 20_000 + "whale"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def built(docs):
    return A.Collection.build(docs)


def python_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        n = ord(c)
        if n <= 0x2F or 0x3A <= n <= 0x40 or 0x5B <= n <= 0x60 or 0x7B <= n <= 0x7E or n in (0xA0, 0xB0):
            out += [word.casefold()] if word else []
            word = ""
        else:
            word += c
    return [w for w in out if w not in set(T.STOP_WORDS)]


def test_words(spark):
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 118
    rng = random.Random(1)
    alphabet = "aZ09 .,-_@[]`{}~\x7f\x80\x9f\xa0°©ßẞςΣſﬁİKÅŉǰΐᾳԱևᏸꭰ\n\t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["the THE A cat", "", None, "ΣΑΣ σας"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.words("text").alias("w")).collect()
    for r in rows:
        assert r.w == python_words(texts[r.i]), texts[r.i]


def test_word_sets(spark):
    df = spark.createDataFrame([(1, [3, 1, 3]), (2, [])], "i int, a array<int>")
    got = df.select("i", T.longer_than("a", 2).alias("two"), T.longer_than("a", -1).alias("any"), T.distinct_sorted("a").alias("d")).orderBy("i").collect()
    assert [(r.two, r.any, r.d) for r in got] == [(True, True, [1, 3]), (False, True, [])]


def test_dense_ids(spark):
    rows = [(random.Random(i).randint(0, 99), i) for i in range(500)]
    got = dense_ids(spark.createDataFrame(rows, "a int, b int"), "n", "a desc", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.n for r in got) == list(range(500))


def test_dictionary(built, spark):
    d = {r.term: r for r in built.dictionary.collect()}
    want, tf, df = [], Counter(), Counter()
    for i, text in DOCS:
        if i is None:
            continue
        words = python_words(text)
        want += [w for w in dict.fromkeys(words) if w not in want]
        tf.update(words)
        df.update(set(words[: A.MAX_DOC_TOKENS]))
    assert {w: r.token_id for w, r in d.items()} == {w: n for n, w in enumerate(want)}
    assert all(d[w].tf == tf[w] and d[w].df == df[w] for w in want) and d["whale"].df == 0
    assert A.add_words(built.dictionary, spark.createDataFrame([("cat", 0)], "term string, ord bigint")).count() == len(want)  # known words change nothing
    more = {r.term: r.token_id for r in A.add_words(built.dictionary, spark.createDataFrame([("zebra", 5), ("ant", 3), ("zebra", 1), ("dog", 0)], "term string, ord bigint")).collect()}
    assert more["zebra"] == len(want) and more["ant"] == len(want) + 1 and len(more) == len(want) + 2
    missing = A.lookup_words(spark.createDataFrame([("antiword",)], "term string"), built.dictionary).first()
    assert missing.token_id is None
    with pytest.raises(PySparkException, match="no such token"):
        A.lookup_tokens(spark.createDataFrame([(999,)], "token_id bigint"), built.dictionary).collect()


def test_stored_lengths(built):
    assert {r.doc_id: r.length for r in A.document_lengths(built.words).collect()} == {i: min(len(python_words(t)), 16_382) for i, t in DOCS if i is not None}
    tokens = {r.doc_id: r.tokens for r in A.token_docs(built.words, built.dictionary).collect()}
    assert len(tokens[7]) == 16_382 and tokens[2] == tokens[3] == []


def test_saved_collection(built, spark, tmp_path):
    built.save(str(tmp_path / "c"))
    again = A.Collection.load(spark, str(tmp_path / "c"))
    assert sorted(again.postings.collect()) == sorted(built.postings.collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=12), max_size=20))
def test_multimap(spark, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "key bigint, values array<bigint>")
    got = {r.token_id: r.doc_ids for r in I.packed(I.index_from_lists(df).withColumnsRenamed({"key": "token_id", "value": "doc_id"})).collect()}
    assert got == {k: sorted(set(v)) for k, v in enumerate(lists) if v}


def index_of(spark, lists):
    return spark.createDataFrame([(k, v) for k, vs in enumerate(lists) for v in vs], "token_id bigint, doc_id bigint")


def test_union(spark):
    parts = [[[0, 10], [1, 2, 3], [4, 5], []], [[], [7], [], []], [[1, 2, 3, 4], [4, 5], [], []]]
    got = {r.token_id: r.doc_ids for r in I.packed(I.union_indexes(*(index_of(spark, p) for p in parts))).collect()}
    assert got == {0: [0, 1, 2, 3, 4, 10], 1: [1, 2, 3, 4, 5, 7], 2: [4, 5]}
    with pytest.raises(PySparkException, match="two indexes"):
        I.union_indexes(index_of(spark, [[1]]), index_of(spark, [[1]])).collect()
    with pytest.raises(ValueError):
        I.doc_limit(index_of(spark, [[1]]), first=1, random=1)


A_LIST, B_LIST = [0, 1, 4, 7, 8, 9, 11, 12, 13, 15, 16, 18, 19], [1, 2, 3, 4, 8, 10, 11, 12, 13, 16, 17, 19]


def test_intersections(spark):
    """One pair, then all pairs of growing lists: by lists, by rarest term and by clusters."""
    lists = [A_LIST, B_LIST] + [[0, *range(t + 1, 20 * (t + 1))] for t in range(1, 12)]
    index = index_of(spark, lists)
    pairs = [(i * 100 + j, i, j) for i in range(len(lists)) for j in range(len(lists))]
    want = {(q, d) for q, i, j in pairs for d in set(lists[i]) & set(lists[j])}
    asked = spark.createDataFrame(pairs, "query_id bigint, t1 bigint, t2 bigint")
    terms = asked.select("query_id", F.explode(F.array("t1", "t2")).alias("token_id"))
    sizes = index.groupBy("token_id").agg(F.count("*").alias("df"))
    assert {(r.query_id, r.doc_id) for r in J.search(index, terms, sizes).collect()} == want
    packed = {r.pair_id: r.doc_ids for r in J.intersect_lists(asked.withColumnRenamed("query_id", "pair_id"), I.packed(index)).collect()}
    assert packed[1] == [1, 4, 8, 11, 12, 13, 16, 19] and {(q, d) for q, ds in packed.items() for d in ds} == want
    clustering = C.clustering_from_list(spark, [(d, d % 6) for d in range(300)])
    got = C.cluster_intersect(asked, C.clustered_postings(index, clustering)).collect()
    assert {(r.query_id, r.doc_id) for r in got} == want and len(got) == len(want) and all(r.cluster_id == r.doc_id % 6 for r in got)


def test_intersections_by_blocks(spark, monkeypatch):
    """Many blocks, bits and short lists, queries of any number of terms: what is shuffled doesn't follow the candidates."""
    from lodestack.operators import blocks as B

    monkeypatch.setattr(B, "BLOCK_POSTINGS", 2500)
    rng = random.Random(5)
    lists = [sorted(rng.sample(range(3000), n)) for n in (2900, 2500, 1500, 700, 90, 40, 5, 1)] + [[]]
    index = index_of(spark, lists)
    asked = [(i * 100 + j, x) for i in range(9) for j in range(9) for x in (i, j)] + [(1000, t) for t in (0, 1, 2)] + [(1001, t) for t in (0, 1, 4)] + [(1002, None), (1002, 0), (1003, 55)]
    want = {}
    for q in {q for q, _ in asked}:
        terms = [t for p, t in asked if p == q]
        found = set.intersection(*(set(lists[t]) if t is not None and t < 9 else set() for t in terms))
        if found:
            want[q] = sorted(found)
    terms = spark.createDataFrame(asked, "query_id bigint, token_id bigint")
    got = J.search(index, terms).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == sorted((q, d) for q, ds in want.items() for d in ds)
    assert {r.query_id: r.n for r in J.search_counts(index, terms).collect()} == {q: len(ds) for q, ds in want.items()}
    assert {r.query_id: r.doc_ids for r in J.search_lists(index, terms).collect()} == {q: ",".join(map(str, ds)) for q, ds in want.items()}
    named = J.search(index, terms.withColumn("query_id", F.format_string("q%d", "query_id")))
    assert sorted((r.query_id, r.doc_id) for r in named.collect()) == sorted((f"q{q}", d) for q, ds in want.items() for d in ds)


QUERIES = [(1, "cat dog"), (2, "the"), (3, ""), (4, None), (5, "cat unicorn"), (6, "dog dog"), (7, "cat dog bird fish"), (8, "fish bird")]


def test_search_report(spark, built):
    queries = spark.createDataFrame(QUERIES, "query_id bigint, raw string")
    got = {r.query_id: (r.status, r.n_docs, r.first_docs) for r in J.search_report(queries, built.dictionary, built.postings).collect()}
    none = "empty or only stop words"
    assert got == {1: ("ok", 2, [0, 5]), 2: (none, 0, []), 3: (none, 0, []), 4: (none, 0, []), 5: ("unknown terms", 0, []), 6: ("ok", 3, [0, 1, 5]), 7: ("ok", 1, [5]), 8: ("ok", 1, [5])}

    def kept(**limits):
        return sorted(r.query_id for r in J.filter_queries(queries, built.dictionary, built.postings, **limits).collect())

    assert kept() == [1, 2, 3, 4, 5, 6, 7, 8] and kept(threshold=0) == kept(threshold=-1) == kept()
    assert kept(threshold=2) == [1, 6] and kept(min_terms=2) == [1, 5, 6, 7, 8] and kept(min_terms=2, max_terms=2, threshold=1) == [1, 6, 8]


def test_pairs(spark, built):
    ids = {r.term: r.token_id for r in built.dictionary.collect()}
    queries = spark.createDataFrame(QUERIES, "query_id bigint, raw string")
    two = {(r.query_id, r.t1, r.t2) for r in J.pairs_of_two(queries, built.dictionary).collect()}
    assert two == {(1, ids["cat"], ids["dog"]), (8, ids["fish"], ids["bird"])}
    one = {(r.query_id, r.t1, r.t2) for r in J.pairs_of_all(queries, built.dictionary).collect()}
    assert one == {(1, ids["cat"], ids["dog"]), (8, ids["bird"], ids["fish"])}
    assert J.pairs_of_all(queries, built.dictionary, expand=True).where("query_id = 7").count() == 6


def test_clusterings(spark):
    clustering = C.clustering_from_list(spark, [(d, d % 4 * 2) for d in range(10)])
    assert [r.doc_id for r in C.members(clustering, 2).collect()] == [1, 5, 9]
    assert {r.cluster_id: r.size for r in C.cluster_sizes(clustering).collect()} == {0: 3, 1: 0, 2: 3, 3: 0, 4: 2, 5: 0, 6: 2}
    new = {r.doc_id: r.new_id for r in C.relabel(clustering).collect()}
    assert [d for d, _ in sorted(new.items(), key=lambda x: x[1])] == sorted(range(10), key=lambda d: (d % 4, d))
    wide = {r.doc_id: r.new_id for r in C.relabel_pow2(clustering).collect()}
    assert wide == {d: 4 * (d % 4) + (d // 4) * 4 // (3 if d % 4 < 2 else 2) for d in range(10)}
    with pytest.raises(PySparkException, match="fills its range"):
        C.relabel_pow2(C.clustering_from_list(spark, [(d, 0) for d in range(8)])).collect()
    assert {r.cluster_id for r in C.without_empty(clustering).collect()} == {0, 1, 2, 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 12))
def test_exactly_k(sizes, k):
    merged, ranges = C.merge_and_split(sizes, k)
    total = Counter()
    for c, m in enumerate(merged):
        total[m] += sizes[c]
    seen = Counter()
    for m, rs in ranges.items():
        at = 0
        for lo, hi, n in sorted(rs):
            assert lo == at
            at = hi
            seen[n] += hi - lo
        assert at == total[m]
    assert len(seen) == k and sum(seen.values()) == sum(sizes)


def test_normalised(spark):
    rows = [(d, int(math.sqrt(d)), (d * 7) % 60) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, cluster_id bigint, idx bigint")
    for k in (3, 8, 12):
        got = C.normalise(df, k).collect()
        assert len(got) == 60 and {r.cluster_id for r in got} == set(range(k))


# Costs and codes


def test_log_complexity(spark):
    rows = spark.createDataFrame([(x, y) for x in range(0, 60, 7) for y in range(0, 60, 5)], "x bigint, y bigint")
    table = X.log_factorials(spark, 120)
    for r in X.log_complexity(rows, "x", "y", "c", table, 120).collect():
        assert r.c == math.floor(math.lgamma(r.x + r.y + 1) - math.lgamma(r.x + 1) - math.lgamma(r.y + 1) + 1e-9)
    with pytest.raises(PySparkException, match="out of precalculated range"):
        X.log_complexity(rows, "x", "y", "c", table, 50).collect()


def python_golomb(b, x):
    q, lb = (x - 1) // b, math.floor(math.log2(b))
    r = x - q * b - 1
    return q + 1 + (lb if r < 2 ** (lb - 1) else math.ceil(math.log2(b)))


def python_factor(n, k):
    return max(2, round(n / k * math.log(2))) if k else 2


def test_codes(spark):
    rng = random.Random(2)
    lists = [sorted(rng.sample(range(5000), n)) for n in (1, 2, 7, 8, 9, 64, 65, 700)]
    rows = {r.token_id: r for r in Z.code_sizes(Z.gaps(index_of(spark, lists).repartition(5))).collect()}
    for t, ids in enumerate(lists):
        gaps = [b - a for a, b in zip([-1, *ids], ids)]
        got, lg = rows[t], lambda x: math.floor(math.log2(x))
        assert got.size == len(ids) and got.approx == sum(2 + math.ceil(math.log2(g)) for g in gaps)
        assert got.gamma == sum(1 + 2 * lg(g) for g in gaps)
        assert got.delta == sum(1 + 2 * lg(math.log2(2 * g)) + lg(g) for g in gaps)
        assert got.golomb == sum(python_golomb(python_factor(sum(gaps), len(gaps)), g) for g in gaps)
        for size in Z.BLOCKS:
            want = 0
            for s in range(0, len(gaps), size):
                block = gaps[s : s + size]
                b = python_factor(sum(block), len(block))
                want += 1 + 2 * lg(b - 1) + sum(python_golomb(b, g) for g in block)
            assert got[f"hybrid_{size}"] == want


def test_codes_stay(spark):
    """Gaps are coded where their lists are: one shuffle for all codes, in tasks of bounded rows."""
    index = index_of(spark, [[1, 5, 6], [2], list(range(0, 300, 3))])
    plan = Z.code_sizes(Z.gaps(index))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# Clustering by term frequencies


def corpus(n=60, terms=25, seed=3):
    rng = random.Random(seed)
    return {d: sorted(rng.sample(range(terms), rng.randint(0, 6))) for d in range(n)}, {t: rng.randint(1, 9) for t in range(terms)}


def naive_scores(docs, w, assigned, k, exact):
    c = [Counter(t for d, a in assigned.items() if a == j for t in docs[d]) for j in range(k)]
    cf = Counter(t for x in c for t in x)
    above = lambda v, t: sum(w[u] for u in w if v[u] > v[t])
    out = {}
    for d, terms in docs.items():
        for j in range(k):
            s = sum(w[t] * (above(c[j], t) + (above(cf, t) if not c[j][t] else 0)) for t in terms)
            if exact:
                for v, chosen in ((c[j], terms), (cf, [t for t in terms if not c[j][t]])):
                    psum, last = 0, None
                    for t in sorted(chosen, key=lambda t: (-v[t], t)):
                        s += w[t] * psum
                        if v[t] == last:
                            psum += w[t]
                        else:
                            psum, last = 0, v[t]
            out[d, j] = s
    return out


def naive_round(docs, w, k, shrink, exact=False):
    n = len(docs)
    if n == k:
        return {d: d for d in docs}
    m = max(k, int(n * shrink))
    assigned, total, last, passes = naive_round({d: docs[d] for d in range(m)}, w, k, shrink, exact), 0, 0, 0
    while passes < 3 or total * 100 < last * 99:
        s = naive_scores(docs, w, assigned, k, exact)
        assigned = {d: min(((d % k + i) % k for i in range(k)), key=lambda j: s[d, j]) for d in docs}
        total, last, passes = sum(s[d, a] for d, a in assigned.items()), total, passes + 1
    return assigned


def tables(spark, docs, w):
    postings = spark.createDataFrame([(t, d) for d, ts in docs.items() for t in ts], "token_id bigint, doc_id bigint")
    return spark.createDataFrame([(d,) for d in docs], "doc_id bigint"), postings, spark.createDataFrame(list(w.items()), "token_id bigint, w bigint")


def test_scores(spark):
    docs, w = corpus()
    words, postings, weights = tables(spark, docs, w)
    assigned = {d: d % 4 for d in docs if d < 30}
    center_rows = fmf.centers(postings, spark.createDataFrame(list(assigned.items()), "doc_id bigint, cluster_id bigint"))
    rows = words.withColumn("idx", F.col("doc_id"))
    for exact, f in ((False, fmf.scores), (True, fmf.exact_scores)):
        got = {(r.doc_id, r.cluster_id): r.score for r in f(rows, postings, center_rows, weights, 4).collect()}
        assert got == naive_scores(docs, w, assigned, 4, exact)


def test_scores_by_blocks(spark, monkeypatch):
    """Many blocks, terms without a centre, documents without terms: as plain Python and as the joins say."""
    from lodestack.operators import blocks as B

    monkeypatch.setattr(B, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(B, "RUN", 4)
    docs, w = corpus(200, 40, 9)
    words, postings, weights = tables(spark, docs, w)
    assert B.dealt(postings)[0] > 5
    assigned = {d: d % 3 for d in docs if d < 20}
    center_rows = fmf.centers(postings, spark.createDataFrame(list(assigned.items()), "doc_id bigint, cluster_id bigint"))
    rows = words.withColumn("idx", F.col("doc_id"))
    for exact, f in ((False, fmf.scores), (True, fmf.exact_scores)):
        got = {(r.doc_id, r.cluster_id): r.score for r in f(rows, postings, center_rows, weights, 5).collect()}
        assert got == naive_scores(docs, w, assigned, 5, exact)
        joined = {(r.doc_id, r.cluster_id): int(r.score) for r in f(rows, postings, center_rows, weights, 5, "decimal(38,0)").collect()}
        assert got == joined


def test_rounds_agree(spark):
    """Arrays in one task, joins, and plain Python give one assignment."""
    docs, w = corpus(40, 15)
    words, postings, weights = tables(spark, docs, w)
    small = fmf.cluster(words, postings, weights, k=3, shrink=0.3).collect()
    joins = fmf.cluster(words, postings, weights, k=3, shrink=0.3, local=0).collect()
    by_order = {r.idx: r.cluster_id for r in small}
    order = {r.idx: r.doc_id for r in small}
    assert {r.idx: r.cluster_id for r in joins} == by_order == naive_round({i: docs[order[i]] for i in range(40)}, w, 3, 0.3)
    big = {t: x << 40 for t, x in w.items()}  # scores beyond 64 bits
    huge = fmf.cluster(words, postings, tables(spark, docs, big)[2], k=3, shrink=0.3).collect()
    assert {r.idx: r.cluster_id for r in huge} == by_order


def test_top_down(spark):
    docs, w = corpus(80, 20)
    words, postings, weights = tables(spark, docs, w)
    got = {r.doc_id: r.cluster_id for r in fmf.cluster_top_down(words, postings, weights, k=10).collect()}
    assert set(got) == set(docs) and set(got.values()) == set(range(10))


def test_conditions(spark):
    docs, w = corpus(5, 5)
    words, postings, weights = tables(spark, docs, w)
    for k, shrink in ((6, 0.3), (2, 1.0), (0, 0.3)):
        with pytest.raises(ValueError):
            fmf.cluster(words, postings, weights, k=k, shrink=shrink)
    with pytest.raises(ValueError):
        fmf.cluster(words, postings, weights.withColumn("w", F.lit(0).cast("bigint")), k=2)


def test_descend():
    got, made = fmf.descend(np.arange(20), lambda at: np.arange(len(at)) % 8, 2)
    assert sorted(np.unique(got)) == list(range(made)) or made == len(np.unique(got)) - 1
