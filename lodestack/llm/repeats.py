"""Exact search for repeated windows of a fixed length over a whole corpus, shared by two operators.

Every window of ``length`` symbols (bytes or words) belongs to the bucket of its smallest ``gram``-symbol
fingerprint. Consecutive windows of one bucket form a segment. Equal windows have equal buckets, so:

1. ``scan`` turns each whole document into segments (about 2 / (length - gram + 2) a symbol). Equal
   segments within a worker's batch meet there already: of any number of copies one row goes on, so a
   passage that a third of all documents holds sends one row per batch, not one per document.
2. One shuffle by bucket finds equal segments of different batches with native window functions.
3. Buckets that hold several different segments (passage borders, edits) are judged window by window:
   their symbols are fetched and handed to the operator's own method, bucket by bucket.
4. Verdicts return to their documents and the covered symbols go.

Text is shuffled once (both joins reuse one exchange), segments once; nothing is collected or broadcast.
Fingerprints have 64 bits; two different segments are only taken for equal if both their bucket and
their own fingerprint agree.
"""

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import materialise, partitions, small_batches

_SEGMENTS = "kind tinyint, bucket bigint, seg bigint, doc bigint, th bigint, at bigint, copies int, blob binary"
_FETCHED = "bucket bigint, doc bigint, th bigint, at bigint, judged boolean, symbols binary"
_VERDICTS = "doc bigint, th bigint, at bigint"
#: Text bytes whose fingerprints a worker holds at once; these take many times the room. A longer document is taken alone, whole.
_SLICE = 1 << 20
#: Segments that a worker holds before equal ones are merged and sent on.
_HELD = 600_000
#: Symbols of whole buckets that are judged at once; a larger bucket is judged alone.
_JUDGED = 1 << 19


@dataclass(frozen=True)
class Spec:
    """words: symbols are words, else bytes. earlier: a window goes if it also starts in a document of
    smaller id, else if it also starts anywhere else. judge: (symbols, bounds, docs) -> mask over the
    window starts of all symbols, for some whole buckets whose segments are sorted by document."""

    words: bool
    length: int
    gram: int
    earlier: bool
    judge: Callable


def find_segments(symbols: np.ndarray, first: np.ndarray, length: int, gram: int):
    """Bucket, fingerprint, document, start and number of windows of each segment."""
    roll = K.Rolling(symbols)
    grams = roll.windows(gram)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    width = length - gram + 1
    if len(grams) < width:
        return none
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = K.slide_min(grams, width)
    n = np.maximum(np.diff(first) - length + 1, 0)  # windows of each document
    inside = np.zeros(len(least) + 1, np.int8)
    has = n > 0
    np.add.at(inside, first[:-1][has], 1)
    np.add.at(inside, (first[:-1] + n)[has], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    new = inside.copy()
    # A segment's windows share the place of their first smallest gram, so no two of them are equal.
    new[1:] &= (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
    new[first[:-1][has]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none
    doc = np.searchsorted(first, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(least)), (first[:-1] + n)[doc])
    seg = K.mix(roll.spans(start, end + length - 1) ^ np.uint64(0x51ED270B))
    return least[start], seg, doc, start - first[doc], end - start


def document_symbols(data: np.ndarray, offsets: np.ndarray, words: bool):
    """Symbol values of some documents, and where each document's begin."""
    if not words:
        return K.BYTE_VALUE[data], offsets
    start, end, first = K.word_spans(data, offsets)
    return K.word_values(data, start, end), first


def _merged(parts: list, earlier: bool):
    """Rows for one worker's segments: equal ones are merged, and what that settles is told by document."""
    bucket, seg, doc, th, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, th, doc, seg, bucket))
    bucket, seg, doc, th, at = (x[order] for x in (bucket, seg, doc, th, at))
    new = np.ones(len(seg), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (seg[1:] != seg[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    least = doc[np.flatnonzero(new)][group]
    settled = doc > least if earlier else size[group] > 1
    sent = ~settled if earlier else new
    copies = size[group].astype(np.int32)
    rows = [np.zeros(int(sent.sum()), np.int8), bucket[sent].view(np.int64), seg[sent].view(np.int64), doc[sent], th[sent], at[sent], copies[sent]]
    batch = [pa.array(x) for x in rows] + [pa.nulls(int(sent.sum()), pa.binary())]
    yield pa.RecordBatch.from_arrays(batch, names=[x.split()[0] for x in _SEGMENTS.split(", ")])
    if settled.any():
        d, t, a = doc[settled], th[settled], at[settled]
        order = np.lexsort((a, t, d))
        d, t, a = d[order], t[order], a[order]
        cut = np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1
        begin = np.concatenate(([0], cut))
        n = len(begin)
        blobs = [x.tobytes() for x in np.split(a, cut)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int8)), pa.array(K.mix(d[begin].view(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(d[begin]), pa.array(t[begin]), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(blobs, pa.binary())],
            names=[x.split()[0] for x in _SEGMENTS.split(", ")],
        )


def _scanner(spec: Spec):
    def scan(batches):
        parts, held = [], 0
        for b in batches:
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, offsets in K.text_slices(b.column(2), _SLICE):
                bucket, seg, d, s, n = find_segments(*document_symbols(data, offsets, spec.words), spec.length, spec.gram)
                parts.append((bucket, seg, doc[i:j][d], th[i:j][d], s << 32 | n))
                held += len(s)
                if held >= _HELD:
                    yield from _merged(parts, spec.earlier)
                    parts, held = [], 0
        if held:
            yield from _merged(parts, spec.earlier)

    return scan


def _fetcher(spec: Spec):
    def fetch(batches):
        for b in batches:
            lists = b.column(3)
            for i, j, data, offsets in K.text_slices(b.column(2), _SLICE):
                part = lists.slice(i, j - i)
                wanted, count = part.flatten(), np.diff(part.offsets.to_numpy())
                if not len(wanted):
                    continue
                if spec.words:
                    symbols, first = document_symbols(data, offsets, True)
                else:
                    symbols, first = data, offsets
                row = np.repeat(np.arange(j - i), count)
                at = wanted.field(1).to_numpy()
                begin = first[row] + (at >> 32)
                stop = begin + (at & 0xFFFFFFFF) + spec.length - 1
                yield pa.RecordBatch.from_arrays(
                    [wanted.field(0), b.column(0).slice(i, j - i).take(pa.array(row)), b.column(1).slice(i, j - i).take(pa.array(row)), wanted.field(1), wanted.field(2), pa.array([symbols[x:y].tobytes() for x, y in zip(begin, stop)], pa.binary())],
                    names=[x.split()[0] for x in _FETCHED.split(", ")],
                )

    return fetch


def joined_symbols(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all chunks of a binary column, and where each value's begin; they may be over 2 GB."""
    bounds, parts, at = [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)], 0
    for c in column.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            raw = c.buffers()[2]
            parts.append(np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else parts[0])
            bounds.append(ends[1:] - ends[0] + at)
            at = bounds[-1][-1]
    return np.concatenate(parts), np.concatenate(bounds)


def _judge(spec: Spec):
    """Judges complete buckets, some at a time, of rows sorted by bucket and document."""

    def verdicts(rows: pa.Table):
        if not rows.num_rows:
            return
        symbols, bounds = joined_symbols(rows["symbols"])
        if spec.words:
            symbols, bounds = symbols.view(np.uint64), bounds // 8
        doc, at, judged = rows["doc"].to_numpy(), rows["at"].to_numpy(), rows["judged"].to_numpy(zero_copy_only=False)
        found = spec.judge(symbols, bounds, doc, rows["bucket"].to_numpy())
        start, end = K.runs(found)  # windows end before their segment does, so runs never cross
        seg = np.searchsorted(bounds, start, "right") - 1
        keep = judged[seg]
        start, end, seg = start[keep], end[keep], seg[keep]
        where = (at[seg] >> 32) + start - bounds[seg]
        yield pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(rows["th"].to_numpy()[seg]), pa.array(where << 32 | (end - start))], names=["doc", "th", "at"])

    width = 8 if spec.words else 1

    def judge(batches):
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if size + b.nbytes >= _JUDGED * width and (cut or held and last != bucket[-1]):
                yield from verdicts(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.nbytes
            last = bucket[-1]
        if held:
            yield from verdicts(pa.Table.from_batches(held))

    return judge


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the symbols under the window starts that at holds as start << 32 | count."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at >> 32, 1)
    np.add.at(edge, np.minimum((at >> 32) + (at & 0xFFFFFFFF) + length - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, spec: Spec, carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """docs(doc, th, text), one row per document, and spans(doc, th, ats, blobs): the repeated windows of each.

    A row's key is its id and a 64-bit hash of its text, so rows that share a null id and are not alike stay apart. A null id counts as larger than all others. Columns to carry
    stand in a struct ``row`` of docs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    docs = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("th"), "text", *row)
    segments = docs.select("doc", "th", "text").mapInArrow(_scanner(spec), _SEGMENTS).repartition(partitions(spark), "bucket")
    whole = "rows between unbounded preceding and unbounded following"
    same = "partition by bucket, kind, seg order by doc, th, at"
    found = segments.selectExpr(
        "*",
        f"min(doc) over ({same} {whole}) as least",
        f"sum(copies) over ({same} {whole}) as total",
        f"row_number() over ({same}) as nth",
        f"min(seg) over (partition by bucket, kind order by seg, doc, th, at {whole}) <> max(seg) over (partition by bucket, kind order by seg, doc, th, at {whole}) as mixed",
    )
    if spec.earlier:
        gone, asked, judged = "doc > least", "mixed and doc = least", "true"
    else:
        gone, asked, judged = "total > 1 and copies = 1", "mixed and nth = 1", "total = 1"
    found = found.selectExpr("kind", "doc", "th", "at", "blob", "bucket", f"kind = 0 and {judged} as judged", f"kind = 1 or {gone} as gone", f"kind = 0 and {asked} as asked")
    found = materialise(found.where("gone or asked"))
    asked = found.where("asked").groupBy("doc", "th").agg(F.collect_list(F.struct("bucket", "at", "judged")).alias("wanted"))
    judged = (
        docs.join(asked, ["doc", "th"])
        .select("doc", "th", "text", "wanted")
        .mapInArrow(_fetcher(spec), _FETCHED)
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "doc", "th", "at")
        .mapInArrow(_judge(spec), _VERDICTS)
    )
    spans = (
        found.where("gone").select("doc", "th", F.expr("if(kind = 0, at, null)").alias("at"), "blob")
        .unionByName(judged.withColumn("blob", F.lit(None).cast("binary")))
        .groupBy("doc", "th")
        .agg(F.collect_list("at").alias("ats"), F.collect_list("blob").alias("blobs"))
    )
    return docs, spans


def spans_of(ats, blobs) -> list[np.ndarray]:
    """The window starts of each row of a batch, from its two list columns."""
    n = len(ats)
    values, bounds = (np.zeros(0, np.int64), np.zeros(n + 1, np.int64)) if ats.null_count == n else (ats.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ats.value_lengths().fill_null(0).to_numpy()))))
    more = blobs.to_pylist()
    return [np.concatenate((values[bounds[i] : bounds[i + 1]], np.frombuffer(b"".join(more[i] or ()), np.int64))) for i in range(n)]
