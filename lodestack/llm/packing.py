"""Packing token sequences by harmonic classes.

A worker sorts what it packs into classes by reciprocal capacity: class k holds lengths over capacity / (k + 1)
up to capacity / k, and each of its sequences takes exactly k of them. The room that remains in a sequence is
closed by cutting: pieces of documents that did not make up a full sequence of their class, then of the
loosest sequences, which are given up for it. So most documents stay whole and only the last sequence of a
worker's block is padded. Workers need nothing from each other.
"""

import json
import os
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from .session import small_batches

CAPACITY = 2048
END = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens that a worker packs at once; a longer document is packed whole all the same.
BLOCK_TOKENS = 2 << 20
#: The split of a text into the parts that merges never cross, as byte-level vocabularies make it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Ids of a vocabulary file's tokens by their bytes, if it is a plain byte-level BPE whose ids are in the order
    of its merges, so that merging by the least id is what the tokenizer does; else None."""
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not whole.get("normalizer")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in whole["added_tokens"]}
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(p) for p in pairs]
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:])) or len(model["vocab"].keys() - added) != 256 + len(pairs):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return ranks if all(ranks.get(bytes([b]), ids[0]) < ids[0] for b in range(256)) else None


class Encoder:
    """Ids of whole texts, as the tokenizer gives them. Plain byte-level vocabularies are merged by rank, which is several
    times as fast; other ones, and texts that hold the string of a special token, go to the tokenizer itself."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(vocabulary)
        self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked(text), np.uint32)


def encoder(vocabulary: str) -> Encoder:
    cache = K.worker_cache()
    if vocabulary not in cache:
        cache[vocabulary] = Encoder(vocabulary)
    return cache[vocabulary]


def pack(lengths, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each document's tokens once; lengths of 0 give nothing."""
    full, classes = [], {}
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            classes.setdefault(capacity // (n - whole), []).append((d, whole, n - whole))
    rows, spare = [], deque()
    for k, pieces in sorted(classes.items()):
        pieces.sort(key=lambda p: -p[2])  # like lengths together
        even = len(pieces) - len(pieces) % k
        rows += [pieces[i : i + k] for i in range(0, even, k)]
        spare.extend(pieces[even:])
    rows.sort(key=lambda r: -sum(p[2] for p in r))  # the fullest first
    i, j, out = 0, len(rows), []

    def take(room: int) -> list:
        nonlocal j
        got = []
        while room and (spare or j > i + 1):
            if not spare:
                j -= 1
                spare.extend(rows[j])
            d, s, n = spare.popleft()
            got.append((d, s, min(n, room)))
            if n > room:
                spare.appendleft((d, s + room, n - room))
            room -= got[-1][2]
        return got

    while i < j:
        out.append(rows[i] + take(capacity - sum(p[2] for p in rows[i])))
        i += 1
    while spare:
        i = j = 0
        out.append(take(capacity))
    return full + out


def _packer(vocabulary: str, capacity: int, end: int):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def rows(held, base):
        ids, tokens = [x[0] for x in held], [x[1] for x in held]
        out = [[] for _ in columns]
        done = 0
        for q, sequence in enumerate(pack([len(t) for t in tokens], capacity)):
            at, done = 0, q + 1
            for d, s, n in sequence:
                piece = np.ascontiguousarray(tokens[d][s : s + n], "<u4")
                for column, x in zip(out, (ids[d], s, n, zlib.crc32(piece), len(tokens[d]), base + q, at, piece.tobytes())):
                    column.append(x)
                at += n
        types = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=columns), done

    def run(batches):
        encode = encoder(vocabulary)
        base, held, size = TaskContext.get().partitionId() << 36, [], 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, text in zip(ids, texts):
                held.append((d, np.append(encode(text or ""), np.uint32(end))))
                size += len(held[-1][1])
                if size >= BLOCK_TOKENS:
                    batch, done = rows(held, base)
                    yield batch
                    base, held, size = base + done, [], 0
        if held:
            yield rows(held, base)[0]

    return run


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit):
    a row for each piece of docs(doc_id, text), whose ids are followed by the id ``end``.

    Null and empty texts are that id alone. Repeated rows are packed each for itself; null ids are kept. Texts
    of any length are encoded whole and cut into sequences. Extra columns are ignored; an empty table gives an
    empty table. Sequence ids are unique, not dense. There is no shuffle: each task packs the rows it reads.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_packer(vocabulary, capacity, end), schema)
