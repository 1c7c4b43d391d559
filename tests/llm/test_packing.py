import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestack.llm import packing as P

TOKENIZER = Tokenizer.from_file(P.VOCABULARY)


def check(lengths, capacity=2048):
    sequences = P.pack(lengths, capacity)
    pieces = defaultdict(list)
    for s in sequences:
        assert 0 < sum(n for *_, n in s) <= capacity and all(n > 0 for *_, n in s)
        for d, start, n in s:
            pieces[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces.get(d, [])):
            assert start == at
            at += k
        assert at == n
    assert len(sequences) == -(-sum(lengths) // capacity)  # only the last is short
    return sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6000), max_size=60))
def test_pack(lengths):
    check(lengths)


def test_few_cuts():
    lengths = np.random.default_rng(0).lognormal(6, 1, 5000).astype(int).tolist()
    assert sum(map(len, check(lengths))) < len(lengths) + 1.1 * sum(lengths) / 2048


@pytest.mark.parametrize("name", ["odd", "none", "corpus"])
def test_documents(request, name):
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(P.VOCABULARY)
    want = sorted((str(r.doc_id), tuple(t.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
    rows = P.pack_documents(df).collect()
    whole, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        per_sequence[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = []
    for (d, n), pieces in whole.items():
        parts, at = [], 0
        for start, ids in sorted(pieces):
            if start == 0 and at:  # a repeated row
                got.append((str(d), tuple(parts)))
                parts = []
            parts += ids
            at += len(ids)
        got.append((str(d), tuple(parts)))
    assert sorted(got) == want
    for pieces in per_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_special_strings_and_odd_space():
    e, t = P.encoder(P.VOCABULARY), Tokenizer.from_file(P.VOCABULARY)
    texts = ["", " ", "  a  b\n\n c\t\td ", "it's we'LL '' 's", "x<|endoftext|>y", "日本語 テスト ١٢٣ ½ ²", "   a", "😀😀 !?… --"]
    for x in texts:
        assert e(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'stremvdl1é")), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert P.encoder(P.VOCABULARY)(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_to_their_tokenizer():
    other = public_tokenizers.path("word_bpe_49k.json")
    e, t = P.Encoder(other), Tokenizer.from_file(other)
    assert e.ranked is None and e("Some words, here").tolist() == t.encode("Some words, here", add_special_tokens=False).ids
