"""Removal of passages that an earlier document already holds, word by word.

Suffix automata of reference shards decide: a shard is a bucket of segments (see :mod:`repeats`), its
automaton grows document by document, and each document's matching statistics against the automaton of
all smaller ids show which of its windows are repeated. One automaton for the corpus, broadcast to every
worker, would grow with the corpus; instead documents' segments go to the one shard that can match them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .repeats import Spec, covered, repeated_windows, spans_of

WINDOW_WORDS = 13
GRAM_WORDS = 4


class SuffixAutomaton:
    """All substrings of the sequences added so far; grows online, a sequence at a time."""

    def __init__(self):
        self.step, self.link, self.length = [{}], [-1], [0]

    def add(self, sequence) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None and length[q] == length[last] + 1:  # another sequence has made this state
                last = q
                continue
            if q is not None:
                last = self._split(last, q, c)
                continue
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def matching(self, sequence) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        step, link, length = self.step, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def judge_windows(length: int):
    """Masks the window starts that match in an earlier document of the same bucket."""

    def judge(symbols, bounds, docs, buckets):
        found = np.zeros(len(symbols), bool)
        values = symbols.tolist()
        i, n = 0, len(docs)
        while i < n:
            automaton, bucket, end = SuffixAutomaton(), buckets[i], i
            while end < n and buckets[end] == bucket:
                end += 1
            while i < end:
                same = i
                while same < end and docs[same] == docs[i]:
                    same += 1
                mine = [values[bounds[k] : bounds[k + 1]] for k in range(i, same)]
                if len(automaton.step) > 1:
                    for k, seq in zip(range(i, same), mine):
                        stop = np.flatnonzero(np.asarray(automaton.matching(seq)) >= length)
                        found[bounds[k] + stop - (length - 1)] = True
                if same < end:
                    for seq in mine:
                        automaton.add(seq)
                i = same
        return found

    return judge


def _apply(length: int, carried: list[str], whole: bool):
    def apply(batches):
        for b in batches:
            spans = spans_of(b.column(3), b.column(4))
            total, gone, kept = [], [], []
            for text, at in zip(b.column(2).to_pylist(), spans):
                words = (text or "").encode().split()
                total.append(len(words))
                if len(at):
                    out = covered(at, length, len(words))
                    gone.append(int(out.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~out)]).decode())
                else:
                    gone.append(0)
                    kept.append(text if whole else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *b.columns[5:]], names=["doc", "n_words", "n_removed", "kept", *carried])

    return apply


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, whole: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every word under a window that starts in a document of smaller id is removed.

    kept joins the other words by one space; with whole, a text that loses nothing is kept as it is. With
    carry, a struct ``row`` of the document's other columns follows. docs needs doc_id and text; the names of
    other columns don't matter. Words are runs of other than ASCII white space. Null and empty texts have no
    words and stay empty; texts shorter than the window stay whole. Rows of one id never count against each
    other, and a null id counts as larger than all others. An empty table gives an empty table. Texts are read
    whole, of any length.
    """
    spec = Spec(words=True, length=window, gram=gram, earlier=True, judge=judge_windows(window))
    more = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    rows, spans = repeated_windows(docs, spec, more)
    out = rows.join(spans, ["doc", "th"], "left").select("doc", "th", "text", "ats", "blobs", *(["row"] if more else []))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    if more:
        schema = schema.add(out.schema["row"])
    out = out.mapInArrow(_apply(window, ["row"] if more else [], whole), schema)
    return out.select(F.expr(f"nullif(doc, {2**63 - 1})").alias("doc_id"), "n_words", "n_removed", "kept", *(["row"] if more else []))


def without_repeated_passages(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The columns of docs, texts without repeated passages; documents of which nothing is left go.

    A column n_chars is counted anew. Texts that lose nothing are not touched; null and empty ones lose nothing. Rows of one id
    never count against each other, null ids come after all others, other columns are carried whatever their names, and an empty
    table stays empty.
    """
    out = remove_repeated_passages(docs, window, whole=True, carry=True).where("n_removed = 0 or n_removed < n_words")
    return out.select(*[F.col("doc_id") if c == "doc_id" else F.col("kept").alias(c) if c == "text" else F.expr("if(n_removed = 0, row.n_chars, length(kept))").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
