"""Removal of byte strings that start anywhere else too, by bucket-pointer refinement.

Suffixes are sorted only as far as the window length, and only those that can still be equal to another:
the q-gram buckets of sampled positions (see :mod:`repeats`) leave single suffixes alone; the rest
is refined here. Each suffix points to its bucket; a bucket is split by the bucket pointers that its members
have ``depth`` further on, which doubles the depth; the new pointers serve the next split at once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import Spec, covered, repeated_windows, spans_of

WINDOW_BYTES = 400
GRAM_BYTES = 96
#: Bytes of the first buckets of the refinement.
FIRST = 50


def refine(symbols: np.ndarray, starts: np.ndarray, length: int, first: int = FIRST) -> np.ndarray:
    """Bucket pointers of the suffixes at starts, equal if and only if their first length bytes are equal.

    starts must leave length bytes behind each. A pointer of a suffix that is alone in its bucket is final.
    """
    first = min(first, length)
    grams = K.mix(K.Rolling(K.BYTE_VALUE[symbols]).windows(first))
    pointer = np.zeros(len(symbols), np.int64)
    _, pointer[: len(grams)] = np.unique(grams, return_inverse=True)
    reach = np.zeros(len(symbols) + 1, np.int32)  # positions that some window needs at the present depth
    np.add.at(reach, starts, 1)
    np.add.at(reach, starts + (length - first) + 1, -1)
    alive = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    depth, names = first, len(symbols) + 1
    while depth < length:
        ahead = min(depth, length - depth)  # the last step may overlap
        if ahead + depth >= length:
            alive = starts
        else:
            alive = alive[alive + ahead + depth <= len(symbols)]
        size = np.bincount(pointer, minlength=names)
        split = alive[size[pointer[alive]] > 1]
        if not len(split):
            break
        key = (pointer[split].astype(np.uint64) << np.uint64(32)) | pointer[split + ahead].astype(np.uint64)
        _, inverse = np.unique(key, return_inverse=True)
        pointer[split] = inverse + names
        names += len(split)
        depth += ahead
    return pointer[starts]


def judge_windows(length: int):
    """Masks the window starts whose bytes occur at two places of these buckets or more."""

    def judge(symbols, bounds, docs, buckets):
        found = np.zeros(len(symbols), bool)
        n = np.diff(bounds) - length + 1
        first = np.repeat(bounds[:-1], n)
        starts = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        pointer = refine(symbols, starts, length)
        _, inverse, count = np.unique(pointer, return_inverse=True, return_counts=True)
        found[starts[count[inverse] > 1]] = True
        return found

    return judge


def _apply(length: int):
    def apply(batches):
        for b in batches:
            spans = spans_of(b.column(3), b.column(4))
            sizes, gone, runs, kept = [], [], [], []
            for text, at in zip(b.column(2).to_pylist(), spans):
                data = (text or "").encode()
                sizes.append(len(data))
                if len(at):
                    out = covered(at, length, len(data))
                    gone.append(int(out.sum()))
                    runs.append(len(K.runs(out)[0]))
                    kept.append(np.frombuffer(data, np.uint8)[~out].tobytes())
                else:
                    gone.append(0)
                    runs.append(0)
                    kept.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "th", "n_bytes", "n_removed", "n_spans", "kept"])

    return apply


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every byte under a string of ``window`` bytes that
    also starts elsewhere, in the same document or another, is removed; overlapping places count.

    docs needs doc_id and text; other columns are ignored. Null texts are empty. Texts shorter than the
    window stay whole. Repeated rows are copies of each other, so both lose what they share. Null ids are
    ordinary. What is left may not be valid UTF-8, so it is binary. An empty table gives an empty table.
    """
    spec = Spec(words=False, length=window, gram=gram, earlier=False, judge=judge_windows(window))
    rows, spans = repeated_windows(docs, spec)
    out = rows.join(spans, ["doc", "th"], "left").select("doc", "th", "text", "ats", "blobs")
    out = out.mapInArrow(_apply(window), "doc bigint, th bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.expr(f"nullif(doc, {2**63 - 1})").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
