import re

import pytest

from lodestack.llm import licenses as L


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_base(request, name):
    df = request.getfixturevalue(name)
    rows = L.scan_licenses(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_edited_notices(spark):
    notice = L.TEMPLATES[1][1].split()
    edited = notice[:8] + ["really", "and"] + notice[8:20] + notice[21:]
    rows = [(1, "x y " + " ".join(edited) + " z"), (2, " ".join(notice[:6])), (3, " ".join(reversed(notice)))]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].labels == "mit" and got[1].spans[0]["first"] == 2 and 0.7 <= got[1].score < 1
    assert got[2].labels == got[3].labels == "" and got[2].score == 0


def test_verified_spans(spark):
    """The words that tell version and variant count, and short notices may lack words."""
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "It is licensed under the GNU General Public License, version 2.": "gpl-2",
        "licensed under the GNU Lesser General Public License version 2.1": "",
        "licensed under the GNU Lesser General Public License version 3": "lgpl-3",
        "licensed under the GNU Affero General Public License version 3": "",
        "the text is CC BY-SA 4.0": "cc-by-sa",
        "CC BY-SA 4.0": "cc-by-sa",
        "shared under CC BY-SA 3.0 by us": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        "the general public license version of 3": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.labels for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {t: got[i] for i, t in rows} == texts


def test_repeated_beginnings(spark):
    """A notice after many beginnings of it is found as it is alone, and no letter but A to Z is folded."""
    notice = "licensed under the GNU General Public License, version 2"
    rows = [(1, "licensed under the thing " * 12 + notice), (2, notice), (3, "under the mit \u212aicense"), (4, notice + " " + notice)]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(got[i].labels, got[i].score) for i in (1, 2, 3, 4)] == [("gpl-2", 1.0), ("gpl-2", 1.0), ("", 0.0), ("gpl-2", 1.0)]
    assert [(s["first"], s["last"]) for s in got[4].spans] == [(0, 8), (9, 17)]
