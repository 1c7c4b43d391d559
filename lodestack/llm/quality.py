"""Quality verdicts by a learned decision list over text statistics.

Sequential covering: a rule is grown on two thirds of the labelled rows, one threshold test after the other by
FOIL's gain, then pruned from its end on the other third; rows it covers leave, and the next rule is sought
until none is precise enough. The list becomes one ordered CASE expression that Spark evaluates.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import small_batches

#: Labelled rows that rules are learned from at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
REPEAT_WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_stops"]
#: What rules test: shares of counts, so that texts of any length compare.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
}


def statistics(column) -> list[np.ndarray]:
    """COUNTS of each whole text."""
    parts = []
    for i, j, data, offsets in K.text_slices(column):
        n = j - i
        start, end, first = K.word_spans(data, offsets)
        words = np.diff(first)

        def per_doc(mask):
            sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return sums[offsets[1:]] - sums[offsets[:-1]]

        value = K.word_values(data, start, end)
        doc = np.repeat(np.arange(n), words)
        repeat = np.zeros(len(value), bool)
        windows = K.Rolling(value).windows(REPEAT_WINDOW)
        if len(windows):
            inside = np.flatnonzero(doc[: len(windows)] == doc[REPEAT_WINDOW - 1 :])
            keys = K.mix(windows[inside] + K.mix(doc[inside].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            twin = np.zeros(len(ordered), bool)
            twin[1:] = ordered[1:] == ordered[:-1]
            twin[:-1] |= twin[1:]
            at = inside[order[twin]]
            edge = np.zeros(len(value) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + REPEAT_WINDOW, -1)
            repeat = np.cumsum(edge[:-1]) > 0
        # lines: new-line bytes and document starts begin one
        feed = np.flatnonzero(data == 10)
        line_doc = np.concatenate((np.arange(n), np.searchsorted(offsets, feed, "right") - 1))
        begin = np.concatenate((offsets[:-1], feed + 1))
        order = np.lexsort((begin, line_doc))
        begin, line_doc = begin[order], line_doc[order]
        stop = np.where(np.append(line_doc[1:] == line_doc[:-1], False), np.append(begin[1:], 0) - 1, offsets[line_doc + 1])
        worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
        begin, stop, line_doc = begin[worded], stop[worded], line_doc[worded]
        key = K.mix(K.mix(K.Rolling(K.BYTE_VALUE[data]).spans(begin, stop)) + K.mix(line_doc.astype(np.uint64) + np.uint64(7)))
        _, one = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[one] = False
        word_sums = np.concatenate(([0], np.cumsum(repeat, dtype=np.int64)))
        short = np.concatenate(([0], np.cumsum(end - start <= 3, dtype=np.int64)))
        parts.append(
            [
                words,
                per_doc(~K.WHITE[data] & ((data & 0xC0) != 0x80)),
                per_doc(SYMBOLS[data]),
                np.bincount(line_doc[again], minlength=n),
                word_sums[first[1:]] - word_sums[first[:-1]],
                np.bincount(line_doc, minlength=n),
                per_doc((data >= 65) & (data <= 90)),
                per_doc(np.isin(data, np.frombuffer(b"!?", np.uint8))),
                per_doc((data >= 48) & (data <= 57)),
                short[first[1:]] - short[first[:-1]],
            ]
        )
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named and COUNTS of docs(text): a map over the rows, without a shuffle.

    Null and empty texts have counts of 0. Every row gives one, repeated ones too, an empty table none; columns to keep must not
    have the counts' names."""

    def scan(batches):
        for b in batches:
            last = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:last], *map(pa.array, statistics(b.column(last)))], names=[*keep, *COUNTS])

    small_batches(docs.sparkSession)
    kept = docs.select(*keep).schema
    for c in COUNTS:
        kept = kept.add(c, T.LongType())
    return docs.select(*keep, "text").mapInArrow(scan, kept)


class DecisionList:
    """Ordered rules: each a list of (feature, is_at_least, threshold), all of which must hold for a rejection."""

    def __init__(self, rules: list[list[tuple[str, bool, float]]]):
        self.rules = rules

    def covers(self, rule, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, at_least, t in rule:
            out &= x[f] >= t if at_least else x[f] < t
        return out

    def expression(self) -> Column:
        """False where a rule rejects, true elsewhere."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            test = F.lit(True)
            for f, at_least, t in rule:
                value = F.expr(f"cast({FEATURES[f]} as double)")
                test = test & (value >= F.lit(float(t)) if at_least else value < F.lit(float(t)))
            out = F.when(test, F.lit(False)).otherwise(out)
        return out

    def __str__(self):
        return "\n".join("reject if " + " and ".join(f"{f} {'>=' if a else '<'} {t:.4g}" for f, a, t in r) for r in self.rules)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 4, most_rules: int = 12, most_tests: int = 4) -> DecisionList:
    """Rules for the rows of x that are bad."""
    held = np.arange(len(bad)) % 3 == 2
    rules, left, tester = [], np.ones(len(bad), bool), DecisionList([])

    def best_test(rows):
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        base = np.log2(max(p0, 1e-9) / max(p0 + n0, 1e-9))
        best = (0.0, None)
        for f, v in x.items():
            order = rows[np.argsort(v[rows], kind="stable")]
            values, hits = v[order], np.cumsum(bad[order])
            cut = np.flatnonzero(values[1:] > values[:-1])
            if not len(cut):
                continue
            below_p, below = hits[cut].astype(float), (cut + 1).astype(float)
            middle = (values[cut] + values[cut + 1]) / 2
            for at_least, p, n in ((False, below_p, below), (True, p0 - below_p, p0 + n0 - below)):
                gain = np.where(p >= 1, p * (np.log2(np.maximum(p, 1e-9) / n) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (f, at_least, float(middle[k])))
        return best[1]

    def worth(rule, rows):
        c = tester.covers(rule, x) & rows
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < most_rules and bad[left].sum() >= least:
        rule, rows = [], np.flatnonzero(left & ~held)
        while len(rule) < most_tests and len(rows) and not bad[rows].all():
            test = best_test(rows)
            if test is None:
                break
            rule.append(test)
            rows = rows[tester.covers([test], {f: v[rows] for f, v in x.items()})]
        if not rule:
            break
        pruning = left & held
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r, pruning), -len(r)))
        covered = tester.covers(rule, x) & left
        if bad[covered].sum() < least or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return DecisionList(rules)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learns from at most sample_rows rows of labels(doc_id, quality); only their statistics reach the driver.

    Rows with a null id or label are left out; of several labels of one document the lower one holds, and every row of docs with
    that id counts. Null and empty texts are rows without words. Without labels, or without documents, there are no rules."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = text_statistics(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality")
    got = rows.selectExpr("doc_id", "quality", *(f"cast({e} as double) as `{f}`" for f, e in FEATURES.items())).toPandas().sort_values("doc_id")
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy(int) == 0)


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for every row of docs(doc_id, text), with rules from labels(doc_id, quality).

    Null and empty texts have no words and fail the base rules. Repeated rows get equal verdicts, null ids are
    kept, extra columns are ignored, an empty table gives an empty table. Without labels no rule is learned and
    only the base rules reject.
    """
    rules = train(docs, labels, sample_rows)
    out = text_statistics(docs, "doc_id").withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & rules.expression())
