"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and holds centroids only, so its size is bounded too; every vector of
the table is filed under its leaf. A query walks the tree through a priority queue of branches, nearest
centroid first, and visits leaves in the order in which they come up. How many it visits is calibrated: the
number widens until a bounded set of calibration queries, held against all vectors, reaches the wanted recall;
a query goes on beyond it until its leaves hold as many candidates as it asks for.
A leaf is dealt out in blocks of vectors and of the queries that visit it, so no task sees a whole large leaf.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialise, partitions, small_batches

#: Vectors that the tree is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
BRANCHES = 8
#: Sample vectors of a leaf at most.
LEAF_SAMPLE = 64
#: Queries that calibrate the search at most, and the share of their true neighbours that must be found.
CALIBRATION_QUERIES = 64
RECALL = 0.97
NEIGHBOURS = 10
#: Vectors of a leaf that one task searches at once.
BLOCK_ROWS = 8192
#: Queries of a leaf that one task answers at once.
BLOCK_QUERIES = 4096


class Tree:
    """centres of all nodes, children of each (empty: a leaf), and the number of each leaf."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE):
        self.centres, self.children = [sample.mean(0) if len(sample) else np.zeros(1)], [[]]
        rng, work = np.random.default_rng(0), [(0, np.arange(len(sample)))]
        while work:
            node, rows = work.pop()
            if len(rows) <= leaf:
                continue
            x = sample[rows]
            centres = x[rng.choice(len(x), min(branches, len(x)), replace=False)]
            centres = np.unique(centres, axis=0)
            if len(centres) < 2:
                distinct = np.unique(x, axis=0)
                if len(distinct) < 2:
                    continue
                centres = distinct[np.linspace(0, len(distinct) - 1, min(branches, len(distinct))).astype(int)]
            for _ in range(8):
                near = nearest(x, centres)
                centres = np.stack([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
            near = nearest(x, centres)
            groups = [rows[near == k] for k in range(len(centres))]
            if max(map(len, groups)) == len(rows):
                continue
            for k, group in enumerate(groups):
                if len(group):
                    self.children[node].append(len(self.centres))
                    work.append((len(self.centres), group))
                    self.centres.append(centres[k])
                    self.children.append([])
        self.centres = np.array(self.centres)
        self.leaves = sum(not c for c in self.children)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf (node) of each vector."""
        at, out = [(0, np.arange(len(x)))], np.zeros(len(x), np.int64)
        while at:
            node, rows = at.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = node
                continue
            near = nearest(x[rows], self.centres[self.children[node]])
            at += [(c, rows[near == k]) for k, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, least: int, sizes: dict[int, int] | None = None, wanted: int = 0) -> list[int]:
        """The first leaves that a query meets, best bin first: at least so many, and until they hold wanted vectors by sizes."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < least or held < wanted):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                d = ((self.centres[self.children[node]] - q) ** 2).sum(1)
                order = np.argsort(d, kind="stable")
                for k in order[1:]:
                    heapq.heappush(queue, (float(d[k]), self.children[node][k]))
                node = self.children[node][order[0]]
            out.append(node)
            held += sizes.get(node, 0) if sizes else 0
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences, so that equal vectors are at 0."""
    return np.stack([np.sqrt(((vectors - q) ** 2).sum(1)) for q in queries]) if len(queries) else np.zeros((0, len(vectors)))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def best(queries, query_ids, vectors, ids, k: int):
    """(query id, id, distance) of the k nearest of each query, ties to smaller ids, never its own id."""
    out, order = [], np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    for s in range(0, len(queries), 64):
        for q, d in zip(query_ids[s : s + 64], distances(queries[s : s + 64], vectors)):
            d = np.where(ids == q, np.inf, d)
            if len(d) > 4 * k:
                limit = np.partition(d, k - 1)[k - 1]
                at = np.flatnonzero(d <= limit)
            else:
                at = np.arange(len(d))
            at = at[np.argsort(d[at], kind="stable")][:k]
            out += [(int(q), int(ids[i]), float(d[i])) for i in at if np.isfinite(d[i])]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, the commonest length, finite, not all zero."""
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (length.d if length else 0))
    good = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return rows.where(good).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by query_id order by score, vec_id)").cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(queries: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, most: int = CALIBRATION_QUERIES) -> DataFrame:
    """The true neighbours of at most ``most`` queries: a bounded set of queries against all rows, in blocks."""
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().combine_chunks()
    ids = np.array(chosen["vec_id"].to_pylist(), np.int64)
    q = _matrix(chosen["embedding"].chunk(0)) if len(ids) else np.zeros((0, 1))

    def search(batches):
        for b in batches:
            found = best(q, ids, _matrix(b.column(1)), b.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score"), r)) for r in found], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return _top(vectors.mapInArrow(search, "query_id bigint, vec_id bigint, score double"), k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors(vec_id, embedding) found for each query.

    score is the Euclidean distance in double precision; ties go to smaller ids; a query never finds its own
    id. Rows with a null id, and vectors that are null, zero, of another than the commonest length, or that
    hold null or non-finite components take no part, as queries neither. Fewer rows than k give fewer ranks.
    Repeated rows are candidates each for itself. Extra columns are ignored; empty tables give an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow().combine_chunks()
    tree = Tree(_matrix(sample["embedding"].chunk(0)) if sample.num_rows else np.zeros((0, 1)))

    def file(batches):
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(tree.file(x)), b.column(0), b.column(1)], names=["leaf", "vec_id", "embedding"])

    filed = materialise(rows.mapInArrow(file, "leaf bigint, vec_id bigint, embedding array<double>"))

    # The place of each true neighbour's leaf in its query's order of visits; at most CALIBRATION_QUERIES * k rows.
    true = exact(asked, rows, k).select("query_id", F.col("vec_id"))
    places = true.join(filed.select("leaf", "vec_id"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "leaf", "embedding").toArrow().to_pylist()
    order: dict[int, dict[int, int]] = {}
    for p in places:
        if p["query_id"] not in order:
            order[p["query_id"]] = {leaf: n for n, leaf in enumerate(tree.visits(np.array(p["embedding"]), tree.leaves))}
    needed = sorted(order[p["query_id"]][p["leaf"]] + 1 for p in places)
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1

    sizes = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row for each leaf of the bounded tree

    def visit(batches):
        for b in batches:
            ids, x, own = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            index, leaf = [], []
            for i, q in enumerate(x):
                found = [node for node in tree.visits(q, visits, sizes, k + int(own[i])) if node in sizes]  # its own rows are no candidates
                index += [i] * len(found)
                leaf += found
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(ids[index] if index else [], pa.int64()), b.column(1).take(pa.array(index, pa.int64()))], names=["leaf", "query_id", "embedding"])

    own = rows.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    visiting = materialise(asked.join(own, "vec_id").select("vec_id", "embedding", "own").mapInArrow(visit, "leaf bigint, query_id bigint, embedding array<double>"))
    # A leaf's vectors and its queries are both dealt out in blocks; every block of one meets every block of the other.
    asking = {r.leaf: r["count"] for r in visiting.groupBy("leaf").count().collect()}  # a row for each leaf
    plan = spark.createDataFrame([(leaf, -(-sizes[leaf] // BLOCK_ROWS), -(-q // BLOCK_QUERIES)) for leaf, q in asking.items()], "leaf bigint, blocks int, turns int")
    plan = F.broadcast(plan)
    dealt = filed.join(plan, "leaf").select("leaf", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("block"), F.expr("explode(sequence(0, turns - 1))").alias("turn"), "vec_id", "embedding")
    visiting = visiting.join(plan, "leaf").select("leaf", F.expr("explode(sequence(0, blocks - 1))").alias("block"), F.expr("cast(pmod(xxhash64(query_id), turns) as int)").alias("turn"), "query_id", "embedding")
    n = partitions(spark)

    def search(left, right):
        x, q = left.combine_chunks(), right.combine_chunks()
        out = []
        if x.num_rows and q.num_rows:
            out = best(_matrix(q["embedding"].chunk(0)), q["query_id"].to_numpy(), _matrix(x["embedding"].chunk(0)), x["vec_id"].to_numpy(), k)
        return pa.Table.from_pylist([dict(zip(("query_id", "vec_id", "score"), r)) for r in out], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    part = ["leaf", "block", "turn"]
    pairs = dealt.repartition(n, *part).groupBy(*part).cogroup(visiting.repartition(n, *part).groupBy(*part)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    return _top(pairs, k)
