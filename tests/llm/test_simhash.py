import itertools
import random

import numpy as np
import pytest
import xxhash

from lodestack.llm.simhash import chained, components, fingerprints, near_duplicates, spanning_links


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(nodes, near):
    """Smallest node that each of nodes reaches."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if near(a, b) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_components(request, name):
    df = request.getfixturevalue(name)
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, fingerprint(r.text)) for r in df.collect()]
    fps = sorted({f for _, f in rows})
    root = linked(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in rows:
        least[root[f]] = min(least.get(root[f], i), i)
    want = sorted((i, f, least[root[f]]) for i, f in rows)
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.fp % 2**64, 2**63 - 1 if r.component is None else r.component) for r in near_duplicates(df).collect())
    assert got == want


def test_every_link_has_a_key(spark):
    """Fingerprints of up to three changed bits in any places end up together, those of four need not."""
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        x = sum(1 << b for b in bits)
        segments = [x >> 8 * k & 255 for k in range(8)]
        counts = [s.bit_count() for s in segments]
        starts = [i for i in range(8) if all(sum(counts[(i + k) % 8] for k in range(n)) <= n * 3 / 8 for n in range(1, 9))]
        assert any(counts[i] == counts[(i + 1) % 8] == 0 and sum(counts[(i + k) % 8] > 0 for k in (2, 3, 4)) <= 1 for i in starts)


def test_planted_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 3, 4, 5) for _ in range(3)])
    links = [x for start in range(8) for x in spanning_links(fps, np.arange(len(fps)), start=start)]  # a pair keeps the chain from some start
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    root = linked(range(len(fps)), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= 3)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert {n: got.get(n, n) for n in range(len(fps))} == root


def test_chain_budgets():
    """A difference passes from a start if and only if every prefix keeps its share of the budget."""
    rng = random.Random(2)
    x = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(3000)]
    want = [all((d >> 64 - 8 * n).bit_count() <= n * 3 / 8 for n in range(1, 9)) for d in x]
    assert chained(np.array(x, np.uint64)).tolist() == want and 0 < sum(want) < len(x)


def test_chain_of_links(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 300), (500, 400)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got.get(i, i) == 0 for i in range(201)) and got[500] == got[400] == 300


def test_majority_of_many():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 255, 256, 0, 1000])
    h = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    at, want = 0, []
    for n in counts:
        part = [int(x) for x in h[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n))
        at += n
    assert fingerprints(h, counts).tolist() == want
