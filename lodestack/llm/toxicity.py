"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms of a text: the pair term
raises or lowers what two terms mean together, such as an insult beside a group's name.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import materialise, small_batches

#: Labelled rows that the model is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
TERM_BITS = 24
#: Hashed terms that the model knows for telling the labels apart on their own, and for doing so beside others.
TERMS = 1024
BESIDE = 512
#: Terms, those that speak for toxicity most, beside which other ones are looked for.
ANCHORS = 64
#: Least squared correlation of a term with the label (chi-square by number of rows), and least rows that hold it.
TELLING = 0.0125
HELD = 3
RANK = 4
#: Bytes of the word beginnings that are terms too.
PREFIXES = range(4, 11)

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def hashed_terms(column, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term), each pair once, of the whole texts: lower-cased words (ASCII letters, digits and all other
    characters) and their beginnings of PREFIXES bytes, as stems outlive endings. known: the terms to look for."""
    shift = np.uint64(64 - TERM_BITS)
    wanted = None
    if known is not None:
        wanted = np.zeros(1 << TERM_BITS, bool)
        wanted[known] = True
    rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, data, offsets in K.text_slices(column, 1 << 20):
        start, end, first = K.word_spans(data, offsets, _SEPARATES)
        row = np.repeat(np.arange(i, j), np.diff(first))
        roll = K.Rolling(K.BYTE_VALUE[K.lower_ascii(data)])
        found = []
        for n in (None, *PREFIXES):
            if n is None:
                at, owner, salt = slice(None), row, 1
                value = roll.spans(start, end)
            else:
                at = np.flatnonzero(end - start >= n)
                owner, salt = row[at], 2
                value = roll.spans(start[at], start[at] + n)
            term = (K.mix(value + np.uint64(salt)) >> shift).astype(np.int64)
            if wanted is not None:
                hit = wanted[term]
                owner, term = owner[hit], term[hit]
            found.append(owner << TERM_BITS | term)
        both = np.unique(np.concatenate(found))
        rows.append(both >> TERM_BITS)
        terms.append(both & ((1 << TERM_BITS) - 1))
    return np.concatenate(rows), np.concatenate(terms)


class FactorizationMachine:
    """Second-order machine on binary features, fitted by Adagrad on the logistic loss."""

    def __init__(self, terms: np.ndarray, bias: float, rank: int = RANK):
        self.terms, self.bias = terms, bias
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(1).normal(0, 0.01, (len(terms), rank))

    def features(self, rows: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return rows[:0], hashed[:0]
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        known = self.terms[at] == hashed
        return rows[known], at[known]

    def margin(self, n: int, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.bias + np.bincount(row, self.w[feature], n)
        sums = np.stack([np.bincount(row, self.v[feature, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(row, (self.v[feature] ** 2).sum(1), n)
        return out + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, labels: np.ndarray, row: np.ndarray, feature: np.ndarray, steps: int = 2800, rate: float = 0.1, decay: float = 1e-3):
        """Steps over random batches; a byte for each row and term is held."""
        rng, batch = np.random.default_rng(2), 256
        held = np.zeros((len(labels), len(self.w)), np.uint8)
        held[row, feature] = 1
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(steps if held.size else 0):
            docs = rng.integers(0, len(labels), batch)
            x = held[docs].astype(np.float64)
            sums = x @ self.v
            margin = self.bias + x @ self.w + 0.5 * ((sums**2).sum(1) - x @ (self.v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[docs]) / batch
            slope = x.T @ error
            dw = slope + decay * self.w / len(self.w)
            dv = x.T @ (error[:, None] * sums) - slope[:, None] * self.v + decay * self.v / len(self.w)
            gw += dw**2
            gv += dv**2
            gb += error.sum() ** 2
            self.w -= rate * dw / np.sqrt(gw)
            self.v -= 0.3 * rate * dv / np.sqrt(gv)
            self.bias -= rate * error.sum() / np.sqrt(gb)
        return self


def telling_terms(rows: DataFrame, most: int) -> list[tuple[int, bool]]:
    """(term, speaks for toxicity) of the terms of rows(toxic, terms) that tell the labels apart most, best first.

    Counted where the rows are; the driver gets at most ``most`` of them."""
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < hits < n:
        return []
    found = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit"))
    gap, share = f"(hit - {hits} * (df / {n}))", hits / n
    found = found.where(f"df >= {HELD} and df < {n}").selectExpr("term", f"{gap} > 0 as speaks", f"{gap} * {gap} / ({share * (1 - share)!r}D * df * (1 - df / {n})) / {n} as telling")
    found = found.where(f"telling >= {TELLING}").orderBy(F.desc("telling"), "term").limit(most)
    return [(r.term, r.speaks) for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A machine for labels(doc_id, toxic) of docs(doc_id, text); rows whose crc32(id) mod 5 is 0 stay out.

    At most sample_rows labelled documents are used. Their terms are counted by Spark; the driver gets the best terms, and
    of each document only those, so what is broadcast and what the driver holds is bounded whatever the texts' lengths.
    Rows with a null id or label are left out. Without labels of both kinds the model scores their share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def scan(batches):
        for b in batches:
            row, term = hashed_terms(b.column(2))
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), lists], names=["doc_id", "toxic", "terms"])

    rows = materialise(texts.mapInArrow(scan, "doc_id bigint, toxic int, terms array<int>"))  # sample_rows texts at most
    alone = telling_terms(rows, TERMS)
    anchors = [t for t, speaks in alone if speaks][:ANCHORS]
    # A group's name may be as common in clean texts, and tell only among those that hold an insult too.
    beside = telling_terms(rows.where(F.arrays_overlap("terms", F.lit(anchors).cast("array<int>"))), BESIDE) if anchors else []
    terms = np.unique(np.array([t for t, _ in alone + beside], np.int64))
    known = F.array_intersect("terms", F.lit(terms.tolist()).cast("array<int>"))
    got = sorted((r.doc_id, r.toxic, sorted(r.terms)) for r in rows.select("doc_id", "toxic", known.alias("terms")).collect())  # one order for every run
    label = np.array([x for _, x, _ in got], float)
    hashed = np.array([t for *_, ts in got for t in ts], np.int64)
    row = np.repeat(np.arange(len(got)), [len(ts) for *_, ts in got])
    share = (label.sum() + 0.1) / (len(label) + 1)
    model = FactorizationMachine(terms, float(np.log(share / (1 - share))))
    return model.fit(label, *model.features(row, hashed))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of docs(doc_id, text), a row for each, without a shuffle.

    Null and empty texts get the score of a text without known terms; other columns are left out; an empty table stays empty."""

    def scan(batches):
        for b in batches:
            margin, _ = model.margin(b.num_rows, *model.features(*hashed_terms(b.column(1), model.terms)))
            value = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score, predicted for every row of docs(doc_id, text), from labels(doc_id, toxic).

    Only the text enters a score; ids choose the training rows and nothing else. Null and empty texts get the
    score of a text without known terms. Repeated rows get equal scores. Extra columns are ignored, an empty
    table gives an empty table, and null ids are kept.
    """
    return score(docs, train(docs, labels, sample_rows))


def flag_toxic(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """All columns of docs with a new last column toxic_score (with _ behind while docs has that name); texts are scored where they
    are, without a shuffle. Null and empty texts get the score of a text without known terms; every row stays, repeated ones and
    those with null ids too; columns of any name are carried as they are; an empty table stays empty."""
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    packed = docs.select(F.struct("*").alias("row"), "text")

    def scan(batches):
        for b in batches:
            margin, _ = model.margin(b.num_rows, *model.features(*hashed_terms(b.column(1), model.terms)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], names=["row", "score"])

    small_batches(docs.sparkSession)
    out = packed.mapInArrow(scan, packed.select("row").schema.add("score", T.DoubleType()))
    return out.select("row.*", F.col("score").alias(name))
