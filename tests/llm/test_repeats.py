import random
from collections import Counter

import numpy as np
import pytest

from lodestack.llm.repeats import find_segments
from lodestack.llm.substring import SuffixAutomaton, remove_repeated_passages
from lodestack.llm.suffix import refine, remove_repeated_bytes


def passages(rows, window=13):
    """Brute force: (words, removed, kept text) of each (id, text)."""
    words = [(2**63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((None if i == 2**63 else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def strings(rows, window=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + window] for _, b in data for s in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_passages(request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in remove_repeated_passages(df).collect()), key=str)
    assert got == passages(rows_of(df))


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_bytes(request, name):
    df = request.getfixturevalue(name)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_bytes(df).collect()), key=str)
    assert got == strings(rows_of(df))


def test_few_symbols(spark):
    """Texts over few words and letters: many equal grams, repeats within a text, edits of one passage."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    base = [rng.choice(["x", "yy", "zzz", "w"]) for _ in range(400)]
    for i in range(60, 100):
        edited = list(base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = rng.choice("pqrs")
        rows.append((i, " ".join(edited)))
    rows.append((100, "ab" * 900))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert sorted((tuple(r) for r in remove_repeated_passages(df).collect()), key=str) == passages(rows)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_bytes(df).collect()), key=str) == strings(rows)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 500).astype(np.uint64)
    first = np.array([0, 0, 7, 120, 120, 500])
    _, _, doc, start, count = find_segments(symbols, first, 13, 4)
    got = sorted((d, s + k) for d, s, n in zip(doc, start, count) for k in range(n))
    assert got == [(d, s) for d in range(5) for s in range(max(0, first[d + 1] - first[d] - 12))]


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: "b", 98: "a"})
    return t


def test_words_of_equal_polynomials(spark):
    """Strings whose fingerprints agree modulo any power of two stay apart."""
    one = thue_morse(1024)
    other = one.translate({97: "b", 98: "a"})
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, one), (4, other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in remove_repeated_passages(df).collect()), key=str) == passages(rows)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_bytes(df).collect()), key=str) == strings(rows)


def test_null_ids_and_hashes(spark):
    """Rows that share a null id keep their own spans, also where short hashes of their texts agree."""
    words = [f"x{i}" for i in range(40)]
    texts = [f"{k} " + " ".join(words if k % 2 else words[::-1]) + f" {k}" for k in range(40)] + ["y " * 20, " ".join(words[:20])]
    rows = [(None, t) for t in texts] + [(5, " ".join(words)), (5, "z " * 300), (5, " ".join(words) + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in remove_repeated_passages(df).collect()), key=str) == passages(rows)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_bytes(df).collect()), key=str) == strings(rows)


def test_automaton():
    rng = random.Random(5)
    for _ in range(50):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(4)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        probe = "".join(rng.choice("abc") for _ in range(15))
        want = [max((n for n in range(i + 2) if any(probe[i + 1 - n : i + 1] in t for t in texts))) for i in range(15)]
        assert automaton.matching(probe) == want


def test_refinement():
    rng = np.random.default_rng(2)
    symbols = np.frombuffer((b"ab" * 300 + bytes(rng.integers(97, 99, 900).astype(np.uint8)) + b"ab" * 300) * 2, np.uint8)
    for length in (50, 51, 130, 400):
        starts = np.arange(0, len(symbols) - length + 1, 3)
        got = refine(symbols, starts, length)
        names = {}
        want = [names.setdefault(symbols[s : s + length].tobytes(), len(names)) for s in starts]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_all_chunks_are_judged():
    """A bucket whose symbols come in several chunks, as over 2 GB, is read whole."""
    import numpy as np
    import pyarrow as pa

    from lodestack.llm.repeats import joined_symbols

    values = [b"abc", b"", b"de", b"fgh", b"", b"i"]
    column = pa.chunked_array([pa.array(values[:2], pa.binary()), pa.array([], pa.binary()), pa.array([b"x", *values[2:]], pa.binary()).slice(1)])
    symbols, bounds = joined_symbols(column)
    assert [symbols[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])] == values and bounds.dtype == np.int64


def test_fetching_holds_little():
    """Segments are fetched from many texts without fingerprints of more than about a megabyte at once."""
    import pyarrow as pa

    from lodestack.llm import kernels as K
    from lodestack.llm.repeats import Spec, _fetcher, document_symbols

    texts = [f"{i} " + "ab cd ef gh " * 8000 for i in range(30)] + [None, ""]
    wanted = [[{"bucket": i, "at": 3 << 32 | 2, "judged": True}] if t else [] for i, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("bucket", pa.int64()), ("at", pa.int64()), ("judged", pa.bool_())]))
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, pa.array(texts), pa.array(wanted, kind)], names=["doc", "th", "text", "wanted"])
    K.worker_cache().pop("powers", None)
    got = pa.Table.from_batches(_fetcher(Spec(words=True, length=13, gram=4, earlier=True, judge=None))([batch])).to_pylist()
    assert len(K.worker_cache()["powers"][0][0]) <= (1 << 20) + 1
    alone = [document_symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), True)[0] for t in texts if t]
    assert [(r["bucket"], r["symbols"]) for r in got] == [(i, x[3:17].tobytes()) for i, x in enumerate(alone)]
