from collections import Counter, defaultdict

import corpus_pipeline as C
from pyspark.sql import functions as F

from lodestack.llm import mixing as M
from lodestack.llm.toxicity import score, train

from .test_repeats import passages
from .test_simhash import fingerprint, linked

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in score(docs, train(docs, labels)).where("score >= 0.5").collect():
        del want[r.doc_id]
    out = docs
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, out, SF)
        if k < 4:
            assert out.columns == docs.columns, name
            out = spark.createDataFrame(out.toPandas(), docs.schema)  # as a table that is read again
        if name == "toxicity":
            assert {r.doc_id: r.text for r in out.collect()} == want
        elif name == "near_duplicates":
            fps = {i: fingerprint(t) for i, t in want.items()}
            root, least = linked(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3), {}
            for i, f in fps.items():
                least[root[f]] = min(least.get(root[f], i), i)
            want = {i: t for i, t in want.items() if i in least.values()}
            assert {r.doc_id: r.text for r in out.collect()} == want
        elif name == "substring_dedup":
            cut = {i: t for i, n, gone, t in passages(list(want.items())) if not gone or gone < n}
            assert {r.doc_id: " ".join(r.text.split()) for r in out.collect()} == cut
            assert all(r.n_chars == len(r.text) for r in out.collect())
            taken = {r.doc_id: r.taken for r in M.balance(out).collect()}
        elif name == "mixing":
            got = defaultdict(int)
            for r in out.collect():
                got[r.doc_id] += len(r.text.encode().split())
            assert dict(got) == {i: n for i, n in taken.items() if n}
            rows = Counter((r.doc_id) for r in out.collect())
        else:
            pieces = Counter(r.doc_id for r in out.collect() if r.start == 0)
            assert pieces == rows


def test_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"))
    for start in (docs, none.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("bigint").alias("n_chars"))):
        out = start
        for _, stage in C.STAGES:
            out = spark.createDataFrame(stage(spark, out, SF).collect(), stage(spark, out, SF).schema)


def test_run(spark):
    assert C.run(spark, SF).select("doc_id", "start", "length", "sequence_id", "offset").count() > 0


def test_null_and_repeated_ids(spark):
    """Components are told apart by their texts: ids may be null, or stand for several documents."""
    topics = ["river stone bridge water", "engine piston valve crank", "violin cello flute oboe", "wheat barley oats rye"]
    texts = [" ".join(f"{w}{k}" for k in range(20) for w in t.split()) for t in topics]
    rows = [(i, t, "en", "a", len(t)) for i, t in zip((None, None, 7, 7), texts)] + [(None, texts[0], "en", "b", 1), (9, texts[2], "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    root = linked(sorted({fingerprint(r[1]) for r in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t, *_ in rows:
        r = root[fingerprint(t)]
        least[r] = min(least.get(r, (2**63, t)), (2**63 - 1 if i is None else i, t))
    assert len(least) == 4
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in C.near_duplicates(spark, docs, SF).collect())
    assert got == sorted(least.values())


def test_clashing_names(spark, clashing):
    """Stages keep columns of any name, with their values."""
    wanted = clashing.drop("doc_id", "text", "lang", "source", "n_chars").first()
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns and out.count() and {r[5:] for r in map(tuple, out.collect())} == {tuple(wanted)}
    assert C.packing(spark, clashing, SF).count() >= clashing.count()
