"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and a stop, those closest in relative entropy to taking every document once, under
one token constraint a source, tilt exponentially: a document of size s in source c has rate min(stop, exp(lambda_c s)).
The dual is convex, and separates by source. Newton iterations, kept between the multipliers known to be too small and
too large, find all multipliers at once: each step sums tilted sizes and their slopes over the corpus, as a histogram
of (source, size), and writes a row for each source. Rates become whole copies by systematic rounding in order of size;
what remains of a source's target, less than a document or so, is a partial copy of its largest ones.
Everything is DataFrame and SQL expressions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import discard, materialise

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
CAP = 2.0
NEWTON_STEPS = 60
#: Sources up to which their rows go to every executor (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Share of a target that a source's tilted tokens may be off when its multiplier stands.
TOLERANCE = 1e-11
#: Ranges that a source's documents of about one size are ranked in, so that no task ranks a whole source.
SALTS = 64
#: Rates are rounded in these units, as whole numbers, so that sums of them are exact.
UNIT = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size: its words; null and empty texts have none. A column of that name is replaced; the other columns and
    all rows stay, repeated ones too, and an empty table stays empty."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, target of sizes(source, size, n: documents of that size), a row for each source.

    Sources in code point order, null last, weigh as weights repeat, and share total times all words; a target
    stops at cap times its source's words, and the excess is shared by weight among the others. A source without
    words has target 0, an empty table no rows. Runs over the table of sources: its rows are as many as there are
    sources, not documents.
    """
    cycle = f"element_at(array({', '.join(f'{w}D' for w in weights)}), cast((row_number() over (order by source asc nulls last) - 1) % {len(weights)} as int) + 1)"
    table = sizes.groupBy("source").agg(F.sum(F.expr("size * n")).alias("source_size")).selectExpr("source", "source_size", f"{cycle} as weight")
    # Sources reach their cap in the order of cap * size / weight: the level of the first that does not, the highest that any source meets, holds for all after it.
    ahead = "(order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding)"
    table = table.selectExpr(
        "*",
        f"({total}D * sum(source_size) over () - {cap}D * coalesce(sum(source_size) over {ahead}, 0)) / (sum(weight) over () - coalesce(sum(weight) over {ahead}, 0D)) as level",
    )
    table = table.selectExpr("source", "source_size", "weight", f"max(if(level * weight <= {cap}D * source_size, level, null)) over () as level")
    return table.selectExpr("source", "source_size", f"if(source_size = 0, 0D, least({cap}D * source_size, coalesce(level * weight, {cap}D * source_size))) as target")


def _next() -> list[str]:
    """One safeguarded Newton step, as (lo, hi, dual) of the sums g (tokens above the target) and h (its slope), in words
    that any SQL knows."""
    lo, hi = "(case when g < 0 then dual else lo end)", "(case when g > 0 then dual else hi end)"
    limit = "(2 * greatest(abs(dual), 5e-1))"
    raw = f"(dual + greatest(-{limit}, least({limit}, case when h > 0 then -g / h when g > 0 then -{limit} else {limit} end)))"
    outside = f"({lo} is not null and {hi} is not null and ({raw} <= {lo} or {raw} >= {hi}))"
    return [lo, hi, f"(case when abs(g) <= {TOLERANCE:.0e} * target then dual when {outside} then ({lo} + {hi}) / 2 else {raw} end)"]


def multipliers(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, target, scale, dual of sizes(source, size, n): the dual solution. A document of size s has rate
    min(cap, exp(dual s / scale)); dual is null where every rate is 0 or cap (no target, or one at its stop)."""
    table = targets(sizes, weights, total, cap)
    scale = sizes.groupBy(F.col("source").alias("source_")).agg(F.sum(F.expr("double(size) * size * n")).alias("squares"))
    table = materialise(table.join(scale, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").coalesce(8))
    inner = f"target > 0D and target < {cap}D * source_size"
    settled = table.where(f"not ({inner})").selectExpr("source", "source_size", "target", "double(null) as scale", "double(null) as dual")
    known = ["source", "source_size", "target", "scale", "dual", "lo", "hi"]
    state = table.where(inner).selectExpr(*known[:3], "squares / source_size as scale", "0D as dual", "double(null) as lo", "double(null) as hi")
    few = table.count() <= BROADCAST_SOURCES
    tilt = "exp(dual * size / scale)"
    for _ in range(NEWTON_STEPS):
        rows = state.withColumnRenamed("source", "source_")
        rows = sizes.join(F.broadcast(rows) if few else rows, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        sums = rows.groupBy(*known).agg(
            F.sum(F.expr(f"size * n * least({cap}D, {tilt})")).alias("tokens"),
            F.sum(F.expr(f"if({tilt} < {cap}D, size * n * (size / scale) * {tilt}, 0D)")).alias("h"),
        )
        lo, hi, step = _next()
        sums = sums.selectExpr("*", "tokens - target as g").selectExpr(*known[:4], f"{step} as dual", f"{lo} as lo", f"{hi} as hi", f"abs(g) > {TOLERANCE:.0e} * target as open")
        after = materialise(sums.coalesce(8))  # a row for each source
        discard(state)
        state = after.select(*known)
        state.lodestack_path = after.lodestack_path
        if not after.agg(F.max("open")).first()[0]:
            break
    return state.select(*known[:5]).unionByName(settled)


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, key, source_size, target, rate, copies, taken of docs(doc_id, source, size, key: any bigint, which
    orders rows of one size and id).

    copies are whole copies; taken are words, so taken beyond copies * size (or short of it) is a partial copy.
    The words taken of a source are its target, rounded. No document gives more than cap times its size. Rows that
    agree in size, id and key are alike, so it doesn't matter which of them gives. Other columns are left out; null ids
    and sources are ordinary; documents without words give nothing; an empty table gives an empty table.
    """
    docs = materialise(docs.select("doc_id", "source", "size", "key"))
    sizes = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.coalesce(64))  # each Newton step reads it
    table = multipliers(sizes, weights, total, cap).withColumnRenamed("source", "source_")
    rate = f"case when target <= 0D then 0D when dual is null then {cap}D else least({cap}D, exp(dual * size / scale)) end"
    ranked = docs.join(table, F.col("source").eqNullSafe(F.col("source_")))
    ranked = ranked.selectExpr("doc_id", "source", "size", "key", "source_size", "target", f"cast(round({rate} * {UNIT}) as bigint) as units", f"pmod(coalesce(doc_id, size), {SALTS}) as salt", "cast(floor(8 * log2(size + 1)) as int) as band")
    place = ["source", "band", "salt"]

    def placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col("s_")) & (F.col("band") == F.col("b_")) & (F.col("salt") == F.col("t_"))
        return rows.join(ranges.withColumnsRenamed({"source": "s_", "band": "b_", "salt": "t_"}), on).drop("s_", "b_", "t_")

    # Fractions of copies before a document: those of whole ranges before its own, then of the rows before it there.
    part = f"units % {UNIT}"
    before = ranked.groupBy(*place).agg(F.sum(F.expr(part)).alias("n"))
    before = before.selectExpr(*place, "coalesce(sum(n) over (partition by source order by band, salt rows between unbounded preceding and 1 preceding), 0) as before")
    rows = "(partition by source, band, salt order by size, doc_id nulls last, key rows unbounded preceding)"
    out = placed(ranked, before).withColumn("upto", F.expr(f"before + sum({part}) over {rows}"))
    half = UNIT // 2
    copies = f"units div {UNIT} + (upto + {half}) div {UNIT} - (upto - {part} + {half}) div {UNIT}"
    out = out.drop("before").withColumn("copies", F.expr(f"if(size = 0, 0L, {copies})"))
    # What is still missing, or too much, goes to the largest documents first.
    per_source = out.groupBy("source").agg(F.sum(F.expr("copies * size")).alias("whole"), F.first("target").alias("wanted"))
    per_source = per_source.selectExpr("source as g_", "cast(round(wanted) as bigint) - whole as rest")
    out = out.join(per_source, F.col("source").eqNullSafe(F.col("g_"))).drop("g_")
    out = out.withColumn("room", F.expr(f"if(rest > 0, cast({cap}D * size as bigint) - copies * size, copies * size)"))
    after = out.groupBy(*place).agg(F.sum("room").alias("n"))
    after = after.selectExpr(*place, "coalesce(sum(n) over (partition by source order by band, salt rows between 1 following and unbounded following), 0) as after")
    larger = "sum(room) over (partition by source, band, salt order by size, doc_id nulls last, key rows between 1 following and unbounded following)"
    moved = f"least(room, greatest(0, abs(rest) - after - coalesce({larger}, 0))) * cast(signum(rest) as bigint)"
    return placed(out, after).selectExpr("doc_id", "source", "size", "key", "source_size", "target", f"units / {UNIT} as rate", "copies", f"copies * size + {moved} as taken")


def balance(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken of docs(doc_id, text, source).

    Null and empty texts have size 0 and give nothing; null sources are one source, after all others. Rows of
    one id are documents of their own. Ties of size go by id; rows that agree in both are alike, so it doesn't
    matter which of them gives. Extra columns are ignored; an empty table gives an empty table.
    """
    rows = sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", F.lit(0).cast("bigint").alias("key"))
    return mix(rows, weights, total, cap).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """The rows of docs as the mix takes them: a row for each whole copy, and one cut after its words for a partial copy.

    Every row is numbered as it is written down, and its text shuffled once, to meet its number of copies. A partial
    copy's words stand with one space between; a column n_chars is counted anew for it. Null and empty texts are in
    no mix. Null ids and sources are ordinary, repeated rows are mixed each for itself, of all other columns, whatever
    their names, the values stay; an empty table gives an empty table.
    """
    rows = docs.select(F.struct("*").alias("row")).select("row", F.monotonically_increasing_id().alias("number"))
    rows = materialise(rows)
    keyed = rows.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"))
    # Rows of one size and id go by a hash of their text, so that reruns agree; the number only tells them apart.
    asked = materialise(sized(keyed).select("number", "doc_id", "source", "size", F.xxhash64("text").alias("key")).where("size > 0"))
    taken = mix(asked, weights, total, cap).where("taken > 0").select("doc_id", "source", "size", "key", "taken")
    nth = "row_number() over (partition by doc_id, source, size, key order by {}) as nth"
    taken = taken.selectExpr("doc_id as d_", "source as s_", "size as z_", "key as k_", "taken", nth.format("taken desc"))
    numbered = asked.selectExpr("*", nth.format("number").replace("as nth", "as mth"))
    on = F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("z_")) & (F.col("key") == F.col("k_")) & (F.col("mth") == F.col("nth"))
    chosen = numbered.join(taken, on).select("number", "size", "taken")
    out = rows.join(chosen, "number").withColumn("copy", F.expr("explode(sequence(1L, cast(ceil(taken / size) as bigint)))"))
    whole = "copy * size <= taken"
    cut = f"case when {whole} then row.text else array_join(slice(array_remove(split(row.text, r'[\\x20\\x09-\\x0D]+'), ''), 1, cast(taken % size as int)), ' ') end"
    out = out.select("row", F.expr(whole).alias("whole"), F.expr(cut).alias("text"))
    counted = F.expr("if(whole, row.n_chars, length(text))") if "n_chars" in docs.columns else None
    return out.select(*(F.col("text").alias(c) if c == "text" else counted.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


def _oracle() -> str:
    """DuckDB's form of :func:`balance` over the table documents, every Newton step written out as a table."""
    lo, hi, step = _next()
    rounds = "".join(
        f"""n{i + 1} AS MATERIALIZED (SELECT source, source_size, target, scale, {step} AS dual, {lo} AS lo, {hi} AS hi FROM (
   SELECT st.*, (SELECT sum(size * n * least({CAP}, exp(st.dual * size / st.scale))) FROM hist WHERE hist.source IS NOT DISTINCT FROM st.source) - st.target AS g,
     (SELECT sum(CASE WHEN exp(st.dual * size / st.scale) < {CAP} THEN size * n * (size / st.scale) * exp(st.dual * size / st.scale) ELSE 0 END) FROM hist WHERE hist.source IS NOT DISTINCT FROM st.source) AS h FROM n{i} st)),
""".replace("size * n *", "size * hist.n *")
        for i in range(ORACLE_STEPS)
    )
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
hist AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
w AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w1 AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM w),
w2 AS (SELECT a.*, ({TOTAL}::DOUBLE * (SELECT sum(source_size) FROM w1)::DOUBLE
   - {CAP}::DOUBLE * coalesce((SELECT sum(b.source_size) FROM w1 b WHERE (b.source_size / b.weight, b.source) < (a.source_size / a.weight, a.source)), 0)::DOUBLE)
   / ((SELECT sum(weight) FROM w1) - coalesce((SELECT sum(b.weight) FROM w1 b WHERE (b.source_size / b.weight, b.source) < (a.source_size / a.weight, a.source)), 0)) AS level FROM w1 a),
w3 AS (SELECT source, source_size, weight, (SELECT max(level) FROM w2 WHERE level * weight <= {CAP} * source_size) AS level FROM w2),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least({CAP}::DOUBLE * source_size, coalesce(level * weight, {CAP}::DOUBLE * source_size)) END AS target FROM w3),
n0 AS MATERIALIZED (SELECT source, source_size, target, CASE WHEN target > 0 AND target < {CAP} * source_size THEN (SELECT sum(size::DOUBLE * size * n) FROM hist WHERE hist.source IS NOT DISTINCT FROM t.source) / source_size END AS scale,
   CASE WHEN target > 0 AND target < {CAP} * source_size THEN 0::DOUBLE END AS dual, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM t),
{rounds}
j AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, round((CASE WHEN r.target <= 0 THEN 0 WHEN r.dual IS NULL THEN {CAP} ELSE least({CAP}, exp(r.dual * d.size / r.scale)) END) * {UNIT})::BIGINT AS units,
   ((coalesce(d.doc_id, d.size) % {SALTS}) + {SALTS}) % {SALTS} AS salt, floor(8 * log2(d.size + 1))::INT AS band FROM d JOIN n{ORACLE_STEPS} r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, (sum(units % {UNIT}) OVER (PARTITION BY source ORDER BY band, salt, size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM j),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE units // {UNIT} + (upto + {UNIT // 2}) // {UNIT} - (upto - units % {UNIT} + {UNIT // 2}) // {UNIT} END AS copies FROM k),
e AS (SELECT *, round(target)::BIGINT - (sum(copies * size) OVER (PARTITION BY source))::BIGINT AS rest FROM c),
m AS (SELECT *, CASE WHEN rest > 0 THEN ({CAP} * size)::BIGINT - copies * size ELSE copies * size END AS room FROM e),
f AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY source ORDER BY band, salt, size, doc_id NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS later FROM m)
SELECT doc_id, size, source_size, target, (copies * size + least(room, greatest(0, abs(rest) - later)) * sign(rest))::BIGINT AS taken FROM f
"""


#: Steps that the SQL form writes out; more than any table here takes.
ORACLE_STEPS = 24
ORACLE = _oracle()
