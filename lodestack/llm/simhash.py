"""Near-duplicates by 64-bit SimHash fingerprints, linked at a small Hamming distance by pigeonring chains.

A fingerprint is a ring of eight segments of a byte. If two differ in at most three bits, some start of the
ring has cumulative differences of at most l * 3 / 8 after l segments, for every l: none in the first two,
at most one in the first five. So the first two bytes of that chain and two of the next three agree, which
gives 24 keys of four bytes; no pair that should be linked is missed. Candidates under a key are then held
against the chain's budgets, segment by segment from the key's start, and a pair is only linked under a key whose chain it
keeps to the end, where the budget is the full distance. Only distinct fingerprints are compared, and only a
spanning forest of each key's links goes on, never all of its pairs; keys with more than ``BLOCK``
fingerprints are dealt out as pairs of blocks.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, materialise, partitions, small_batches

BITS = 3
SHINGLE_WORDS = 3
#: Fingerprints under one key that one task compares.
BLOCK = 4096
_LOW = np.uint64(0x0101010101010101)
#: The byte that is left out of the five of a chain: its last three in turn.
_MASKS = (0xFFFFFFFF00, 0xFFFFFF00FF, 0xFFFF00FFFF)


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of counts hashes: a bit is set if it is in more than half of them. No hashes: 0."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    first = np.concatenate(([0], np.cumsum(counts[has])[:-1]))
    chunks = -(-counts[has] // 255)  # a byte holds the sum of 255 bits
    begin = np.repeat(first, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    group = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LOW, begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = np.add.reduceat(lanes, group, axis=0) * 2 > counts[has][:, None]
        for j in range(8):
            out[has] |= over[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _scan(words: int):
    def scan(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            texts = b.column(1).to_pylist()
            hashes, counts = [], []
            for text in texts:
                parts = (text or "").encode().lower().split()
                if not parts:
                    counts.append(0)
                    continue
                joined = b" ".join(parts)
                size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
                n = max(1, len(parts) - words + 1)
                stop = (start + size - 1)[min(words, len(parts)) - 1 :]
                hashes += [digest(joined[x:y], 42) for x, y in zip(start[:n].tolist(), stop.tolist())]
                counts.append(n)
            values = fingerprints(np.array(hashes, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", "th"])

    return scan


def chained(difference: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether differences, whose first segment is the highest byte, stay within l * bits / 8 after l segments for all l.

    Longer prefixes are counted only where the shorter ones passed."""
    near = np.arange(len(difference))
    for segments in range(1, 9):
        if segments * bits // 8 < (segments + 1) * bits // 8 or segments == 8:  # the budget of shorter prefixes is no less
            near = near[np.bitwise_count(difference[near] >> np.uint64(64 - 8 * segments)) <= segments * bits // 8]
    out = np.zeros(len(difference), bool)
    out[near] = True
    return out


def spanning_links(fps: np.ndarray, ids: np.ndarray, bits: int = BITS, start: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the pairs among fps that keep the chain from a start segment: breadth first, each step against those
    not yet reached."""
    turn = np.uint64(8 * start)
    ring = (fps << turn) | (fps >> (np.uint64(64) - turn)) if start else fps
    links, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = chained(ring[left] ^ ring[at], bits)
            if near.any():
                reached = left[near]
                links += [(int(ids[at]), int(x)) for x in ids[reached]]
                queue += reached.tolist()
                left = left[~near]
    return links


def _linker(bits: int):
    def link(batches):
        for b in batches_of_groups(batches):
            key, pair, fp = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(key)]))
            links = []
            for x, y in zip(bounds[:-1], bounds[1:]):
                if y - x > 1:
                    links += spanning_links(fp[x:y].view(np.uint64), fp[x:y], bits, (int(key[x]) >> 40) // len(_MASKS))
            if links:
                a = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a.min(1)), pa.array(a.max(1))], names=["a", "b"])

    return link


def batches_of_groups(batches, least: int = 20_000):
    """Regroups sorted rows (key, pair, ...) into tables that hold whole groups."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key, pair = t.column(0).to_numpy(), t.column(1).to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
        if len(new):
            yield t.slice(0, int(new[-1]) + 1)
            t = t.slice(int(new[-1]) + 1)
        held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of links(a, b) reaches, by alternating large and
    small stars; every round is written to the shared folder. Nodes without links are not listed."""
    links = materialise(links.where("a <> b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every link now points from a larger node to a smaller one
        down = large.where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links, old = materialise(small.where("a <> b").select("a", "b").distinct()), links
        discard(old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (bigint), component, th (a hash of the text), root: fingerprints within 3 bits are linked; component is the smallest
    id reached, and root the component's own name, a fingerprint of it.

    docs needs doc_id and text. Null and empty texts have fingerprint 0 and are linked with it like any other.
    Rows of one id are documents of their own. A null id counts as larger than all
    others, and a component of null ids alone is null: ids do not tell components apart, root does.
    An empty table gives an empty table.
    """
    if bits != BITS:
        raise ValueError("the chains of eight segments are laid out for a distance of 3 bits")
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    none = 2**63 - 1
    prints = materialise(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_scan(words), "doc_id bigint, fp bigint, th bigint").withColumn("doc_id", F.coalesce("doc_id", F.lit(none))))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    keys = []
    for i in range(8):
        ring = f"(shiftrightunsigned(fp, {64 - 8 * i}) | shiftleft(fp, {8 * i}))" if i else "fp"
        keys += [f"(shiftrightunsigned({ring}, 24) & {mask}L) | {(3 * i + j) << 40}L" for j, mask in enumerate(_MASKS)]
    keyed = reps.selectExpr("fp", f"explode(array({', '.join(keys)})) as key")
    dealt = keyed.selectExpr("*", "count(*) over (partition by key) as n", "row_number() over (partition by key order by fp) as r").where("n > 1")
    dealt = dealt.selectExpr("key", "fp", f"cast(ceil(n / {BLOCK}) as int) as blocks", "r")
    dealt = dealt.selectExpr("key", "fp", "blocks", "cast(r % blocks as int) as own", "explode(sequence(0, blocks - 1)) as other")
    dealt = dealt.selectExpr("key", "cast(least(own, other) as bigint) * blocks + greatest(own, other) as pair", "fp")
    links = dealt.repartition(n, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_linker(bits), "a bigint, b bigint")
    rooted = reps.join(components(links), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "component", "root")
    return prints.join(named, "fp").select(F.expr(f"nullif(doc_id, {none})").alias("doc_id"), "fp", F.expr(f"nullif(component, {none})").alias("component"), "th", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of docs, with one document of each component of near duplicates: that of the smallest id, then text hash.

    Null and empty texts are one component with all that is near fingerprint 0. Null ids come last; of rows that agree in id
    and text one stays. Other columns are carried whole, whatever their names; an empty table gives an empty table.
    """
    first = near_duplicates(docs).groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "th")).alias("least"))
    first = first.select("least.d", "least.th")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.coalesce("row.doc_id", F.lit(2**63 - 1)).alias("d"), F.xxhash64("row.text").alias("th"))
    return rows.join(first, ["d", "th"]).dropDuplicates(["d", "th"]).select("row.*")
