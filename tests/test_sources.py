import gzip
import html
import struct

import pytest
from pyspark.sql import functions as F

from lodestack.functions import html as H
from lodestack.operators import index as I
from lodestack.operators.collection import Collection
from lodestack.sources import files, store
from lodestack.streaming.query_stream import answer, query_lines


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_text_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("Cats run")
    (tmp_path / "deep" / "er" / "b.txt").write_text("é\nzwei")
    assert [s for _, s in rows(files.list_files(spark, str(tmp_path)), "file", "size")] == [8, 7]
    assert rows(files.text_files(spark, str(tmp_path)), "offset", "length", "text") == [(0, 6, "é\nzwei"), (0, 8, "Cats run")]
    assert rows(files.query_log(spark, str(tmp_path / "a.txt")), "raw") == [("Cats run",)]


def test_sentences(spark):
    docs = spark.createDataFrame([("x", "a b. Cats run! Dogs"), ("y", None), ("z", ""), ("w", "Big cats?Small dogs run.")], "file string, text string")
    got = files.sentences(docs)
    assert rows(got, "file", "offset", "length", "text") == [("w", 0, 8, "Big cats"), ("w", 9, 14, "Small dogs run"), ("x", 4, 9, " Cats run")]
    assert rows(files.fragment_text(got.drop("text"), docs), "text") == rows(got, "text")


def record(text):
    return struct.pack(">I", len(text)) + text


def test_length_delimited(spark, tmp_path):
    good = record(b"eins zwei") + record(b"") + record("drei é".encode()) + record(b"\xff bad")
    want = [(4, 9, "eins zwei"), (17, 0, ""), (21, 7, "drei é"), (32, 5, "� bad")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a").write_bytes(good)
    (tmp_path / "plain" / "cut").write_bytes(good[:-2])  # no documents at all
    (tmp_path / "plain" / "empty").write_bytes(b"")
    assert rows(files.length_delimited(files.read_bytes(spark, str(tmp_path / "plain"))), "offset", "length", "text") == want
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "a.gz").write_bytes(gzip.compress(good[:11]) + gzip.compress(good[11:]))
    (tmp_path / "zipped" / "torn.gz").write_bytes(gzip.compress(good)[:-9])
    (tmp_path / "zipped" / "no.gz").write_bytes(b"no gzip")
    assert rows(files.length_delimited_gzip(files.read_bytes(spark, str(tmp_path / "zipped"))), "offset", "length", "text") == want


def test_archive(spark, tmp_path):
    one = "<DOC>\n<DOCHDR>\nhttp://x\n</DOCHDR>\n<title>T</title><p>One &amp; &#233; &#x41;</p></DOC>\n"
    two = "<DOC>\n<DOCHDR>\n</DOCHDR>\n<P>Two<BR>lines<Br>here</DOC>\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress((one + two).encode()))
    got = rows(files.archive_pages_gzip(files.read_bytes(spark, str(tmp_path))), "offset", "length", "text")
    assert got == [(0, len(one), "T\n\nOne & é A\n"), (len(one), len(two), "Two\nlineshere")]


def test_html(spark):
    pages = [
        "<html><script>var t='</p>';</script><p>a\n  b</p><ul><li>x<LI>y</ul><h1>H</h1>", "<style>p{}</style>s<STYLE>q</STYLE>t", "<td>1</td><td>2</td><tr></tr>",
        "before<script>never closed <p>x", "<!-- a > b -->c", "1 < 2 and <b>bold</b>", None, "",
    ]
    got = [r.t for r in spark.createDataFrame(list(enumerate(pages)), "i int, p string").orderBy("i").select(H.html_to_text("p").alias("t")).collect()]
    assert got == ["a b\n\n* x\n* y\n\n\nH\n", "st", "1 2 \n", "before", "c", "1 < 2 and bold", None, ""]
    texts = ["&lt;&amp;lt; &#38; &#x20AC; &#9999999; &#xD800; &copy;", "no", "&#65;&#66;x&#", "&hellip;&nbsp;&euro;"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.decode_entities("t").alias("d")).collect():
        known = r.t.replace("&#9999999;", "{big}").replace("&#xD800;", "{odd}")
        assert r.d == html.unescape(known).replace("{big}", "&#9999999;").replace("{odd}", "&#xD800;")


def test_store(spark, tmp_path):
    new = spark.createDataFrame([("b", "two"), ("a", "one"), ("c", "three")], "file string, text string")
    store.write_documents(new, str(tmp_path / "docs"), "file")
    docs = store.load_documents(spark, str(tmp_path / "docs"))
    assert rows(docs, "doc_id", "text") == [(0, "one"), (1, "two"), (2, "three")]
    ids = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "ord bigint, doc_id bigint")
    assert rows(store.documents_by_id(docs, ids), "ord", "text") == [(0, "three"), (1, "one"), (2, "three")]
    c = Collection.build(docs)
    half = [c.postings.where(F.col("doc_id") % 2 == k) for k in range(2)]
    for k in range(2):
        store.write_index(c.dictionary, half[k], str(tmp_path / f"part{k}"))
    store.union_saved(spark, [str(tmp_path / f"part{k}") for k in range(2)], str(tmp_path / "whole"))
    keys, postings = store.load_index(spark, str(tmp_path / "whole"))
    assert keys.count() == 3 and sorted(postings.collect()) == sorted(c.postings.collect())
    assert rows(I.read_list(postings, 1), "doc_id") == [(1,)]
    store.write_index(c.dictionary.limit(1), half[0], str(tmp_path / "short"))
    with pytest.raises(ValueError, match="do not match"):
        store.union_saved(spark, [str(tmp_path / "part0"), str(tmp_path / "short")], str(tmp_path / "none"))
    store.write_report(I.packed(postings), str(tmp_path / "report"))
    lines = spark.read.text(str(tmp_path / "report")).collect()
    assert len(lines) >= 4 and any("[1]" in r.value for r in lines)


def test_stream(spark, tmp_path):
    c = Collection.build(spark.createDataFrame([(0, "cat dog"), (1, "dog")], "doc_id bigint, text string"))
    lines = tmp_path / "lines"
    lines.mkdir()
    for k, text in enumerate(("dog\ncat dog\ndog\n", "unicorn\n\n")):
        (lines / f"{k}.txt").write_text(text)
        answer(query_lines(spark, str(lines)), c.dictionary, c.postings, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [(r.raw, r.status, r.n_docs, r.first_docs) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("", "empty or only stop words", 0, []), ("cat dog", "ok", 1, [0]), ("dog", "ok", 2, [0, 1]), ("dog", "ok", 2, [0, 1]), ("unicorn", "unknown terms", 0, [])]


def test_slices(monkeypatch):
    """A batch is unpacked in slices of bounded bytes, in order and whole."""
    import pyarrow as pa

    monkeypatch.setattr(files, "SLICE", 10)
    content = [b"1234", b"12345", None, b"123456789012", b"", b"1"]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcdef")), pa.array(content, pa.binary())], names=["file", "content"])
    got = [s.column(1).to_pylist() for s in files._slices([batch])]
    assert [x for s in got for x in s] == content and all(len(s) == 1 or sum(len(x or b"") for x in s) <= 10 for s in got) and len(got) == 3
