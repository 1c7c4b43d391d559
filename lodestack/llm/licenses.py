"""License notices by diagonal voting over word k-grams, in DataFrame expressions only.

Every word 3-gram of every text is hashed and joined with the positions of all templates' 3-grams. A match at
word i of position j votes for the diagonal i - j of that template; each diagonal with a vote is merged with those
up to a few words before and after it (words put in or left out), so no span outgrows its template. Every span is then
verified: the words where the whole template would lie are held against it by word edits, and the words that tell a
license's variant and version must stand there as they are. Of overlapping spans with different labels the one
with the smaller share of edits stays. Words are split, exploded, hashed and joined within one stage, so only matches
and one row a document are shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: More than a template has words.
FAR = 1000
#: Diagonals up to this far before and after one are merged with it.
SLACK = 4
#: Share of a template's words that a verified span leaves unedited at least.
ACCEPT = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases: every place counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices and the label that each stands for; the table is small and fixed, so it is broadcast.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]

#: Words that an accepted span of a template holds one after the other, if the template has them.
KEYS = [
    "mit license", "apache license version 2", "gnu general public license", "gnu lesser general public license", "version 3", "gnu general public license version 3",
    "gnu general public license version 2", "gnu lesser general public license version 3", "cc by nc", "cc by sa", "creative commons attribution", "mozilla public license v 2",
]
#: Words that make another license of it if they follow a key that ends in a word.
VARIANTS = ["nc", "sa", "nd", "non", "no", "noncommercial", "sharealike", "share", "noderivatives", "noderivs"]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(base=BASE, templates=TEMPLATES) -> list[tuple[int, str, bool, int, int, str, str, str, str]]:
    """(template, label, is base, its 3-grams, position, the three words, the phrase that a base match must show)."""
    out = []
    for t, (label, text, is_base) in enumerate([(v, k, True) for k, v in base.items()] + [(a, b, False) for a, b in templates]):
        words = text.split()
        grams = len(words) - GRAM + 1
        for j in range(1 if is_base else grams):
            out.append((t, label, is_base, grams, j, *words[j : j + GRAM], text if is_base else ""))
    return out


def verified_rows(base=BASE, templates=TEMPLATES) -> list[tuple[int, int, str, str, str, str]]:
    """(template, its words, those as letters, the letter of each word, its keys as letters, separated by spaces)."""
    out = []
    for t, (_, text) in enumerate(templates, len(base)):
        words = text.split()
        letter = {w: chr(0x4E00 + k) for k, w in enumerate(dict.fromkeys(words))}
        code = "".join(letter[w] for w in words)
        letter |= {w: "!" for w in VARIANTS if w not in letter}
        keys = [k for k in KEYS if f" {k} " in f" {text} "]
        out.append((t, len(words), code, " ".join(f"{w}:{c}" for w, c in letter.items()), " ".join("".join(letter[w] for w in k.split()) for k in keys)))
    return out


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of docs(doc_id, text).

    spans: (label, first, last word, share of the template's 3-grams held) of what the method accepted. Labels are
    distinct, sorted, comma-joined, empty if none; score is 1 with a base place, else the best accepted share,
    else 0. Null and empty texts have no words. Repeated rows and null ids give a row each; extra columns are
    ignored; an empty table gives an empty table. Texts are read whole.
    """
    spark = docs.sparkSession
    grams = spark.sql(f"SELECT t, label, is_base, grams, j, xxhash64(a, b, c) AS h, phrase FROM VALUES {_values(template_rows(base, templates))} AS x(t, label, is_base, grams, j, a, b, c, phrase)")
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.expr(f"array_remove(split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), r'{_SEPARATORS}'), '')").alias("words"))
    checks = spark.sql(f"SELECT t AS vt, n_t, code, str_to_map(letters, ' ', ':') AS letters, filter(split(keys, ' '), x -> x <> '') AS keys FROM VALUES {_values(verified_rows(base, templates))} AS x(t, n_t, code, letters, keys)")
    longest = max(len(p.split()) for p in base)
    each = words.selectExpr("rid", "doc_id", "words", "posexplode_outer(words) as (i, w)")
    each = each.selectExpr("rid", "doc_id", "words", "coalesce(i, 0) as i", "if(i + 2 < size(words), xxhash64(w, get(words, i + 1), get(words, i + 2)), null) as g")
    hits = each.join(F.broadcast(grams), F.col("g") == F.col("h"), "left")
    hits = hits.where("i = 0 or (h is not null and (not is_base or startswith(array_join(slice(words, i + 1, " + str(longest) + "), ' ') || ' ', phrase || ' ')))")
    # A first word may be kept for its document alone: then it holds no template.
    hits = hits.withColumn("real", F.expr(f"h is not null and (not is_base or startswith(array_join(slice(words, i + 1, {longest}), ' ') || ' ', phrase || ' '))"))
    around = f"if(real and not is_base, slice(words, greatest(i - j - {SLACK}, 0) + 1, grams + {GRAM - 1 + 2 * SLACK}), null)"
    hits = hits.selectExpr("rid", "doc_id", f"{around} as around", "cast(size(words) as bigint) as n_words", "cast(i as bigint) as i", "if(real, t, -1) as t", "if(real, label, null) as label", "real and is_base as base", "grams", "j", "cast(i as bigint) - j as diagonal")
    near = f"(partition by rid, t order by diagonal range between {SLACK} preceding and {SLACK} following)"
    place = f"i * {FAR} + j"  # orders by word, then by position in the template
    spans = hits.selectExpr("*", f"size(collect_set(j) over {near}) as held", f"max({place}) over {near} as end", "row_number() over (partition by rid, t, diagonal order by i) as nth")
    spans = spans.where("t < 0 or base or nth = 1")  # a span for each diagonal; base places count all
    spans = spans.join(F.broadcast(checks), F.col("t") == F.col("vt"), "left")
    # The words from where the template's first word lies on this diagonal, to where its last one lies on it, or on that of
    # the last match; what would lie before the text's first word is missing.
    start = "greatest(diagonal, 0)"
    letter = "w -> coalesce(letters[w], '~')"
    for name, stop in (("near", "diagonal + n_t"), ("wide", f"end div {FAR} - end % {FAR} + n_t")):
        part = f"slice(around, cast({start} - greatest(diagonal - {SLACK}, 0) + 1 as int), cast(greatest({stop} - {start}, 0) as int))"
        spans = spans.withColumn(name, F.expr(f"struct(levenshtein(array_join(transform({part}, {letter}), ''), code) as edits, array_join(transform({part}, {letter}), '') as read, least({stop}, n_words) - 1 as last)"))
    spans = spans.withColumn("best", F.expr("if(near.edits <= wide.edits, near, wide)"))
    spans = spans.withColumns({"read": F.expr("best.read"), "edits": F.expr("best.edits / n_t"), "first": F.expr(f"if(base, i, {start})"), "last": F.expr(f"if(base, i + {GRAM - 1}, best.last)")})
    variant = "forall(keys, k -> contains(read, k) and not contains(read, k || '!'))"
    spans = spans.withColumn("share", F.expr("if(base, 1D, held / grams)"))
    spans = spans.withColumn("accepted", F.expr(f"t >= 0 and (base or coalesce(edits <= {1 - ACCEPT:g}D and {variant}, false))"))
    spans = spans.withColumn("kept", F.expr(f"collect_list(if(accepted and not base, struct(t, label, first, last, edits), null)) over (partition by rid)"))
    spans = spans.withColumn("accepted", F.expr(f"accepted and (base or not exists(kept, o -> o.label <> label and o.first <= last and o.last >= first and (o.edits < edits or o.edits = edits and o.t < t)))"))
    # Of one template's overlapping spans the best is told; their label is the same.
    told = f"accepted and (base or not exists(kept, o -> o.t = t and o.first <= last and o.last >= first and (o.edits < edits or o.edits = edits and o.first < first)))"
    spans = spans.withColumn("told", F.expr(told))
    found = spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count(F.expr("if(t >= 0 and base, 1, null)")).alias("n_base"),
        F.min(F.expr("if(t >= 0 and base, first, null)")).alias("first_word"),
        F.max(F.expr("if(t >= 0 and base, first, null)")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.expr("if(t >= 0 and base, label, null)"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.expr("if(accepted, label, null)"))), ",").alias("labels"),
        F.coalesce(F.max(F.expr("if(accepted, share, null)")), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.expr(f"if(told, struct(first, last, label, share), null)"))).alias("spans"),
    )
    return found.drop("rid")


#: DuckDB's form of the scan over the table documents, on words themselves in place of hashes.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT * FROM (VALUES {_values(template_rows())}) AS x(t, label, is_base, grams, j, a, b, c, phrase)),
v AS (SELECT vt, n_t, code, map_from_entries(list_transform(string_split(letters, ' '), lambda x: (split_part(x, ':', 1), split_part(x, ':', 2)))) AS letters, list_filter(string_split(keys, ' '), lambda x: x <> '') AS keys
   FROM (VALUES {_values(verified_rows())}) AS x(vt, n_t, code, letters, keys)),
e AS (SELECT rid, unnest(range(len(words))) AS i, words FROM d),
h0 AS (SELECT rid, i::BIGINT AS i, t, label, is_base AS base, grams, j, i - j AS diagonal, words[greatest(i - j - {SLACK}, 0) + 1 : greatest(i - j - {SLACK}, 0) + grams + {GRAM - 1 + 2 * SLACK}] AS around
   FROM e JOIN g ON words[i + 1] = a AND words[i + 2] = b AND words[i + 3] = c WHERE NOT is_base OR starts_with(array_to_string(words[i + 1 : i + 4], ' ') || ' ', phrase || ' ')),
h1 AS (SELECT *, count(DISTINCT j) OVER near AS held, max(i * {FAR} + j) OVER near AS z, row_number() OVER (PARTITION BY rid, t, diagonal ORDER BY i) AS nth
   FROM h0 WINDOW near AS (PARTITION BY rid, t ORDER BY diagonal RANGE BETWEEN {SLACK} PRECEDING AND {SLACK} FOLLOWING)),
s0 AS (SELECT *, greatest(diagonal, 0) AS start, greatest(diagonal, 0) - greatest(diagonal - {SLACK}, 0) + 1 AS spot, diagonal + grams + {GRAM - 1} AS stop1, z // {FAR} - z % {FAR} + grams + {GRAM - 1} AS stop2 FROM h1 WHERE base OR nth = 1),
r AS (SELECT s0.*, n_t, code, keys, array_to_string(list_transform(around[spot : spot + greatest(stop1 - start, 0) - 1], lambda w: coalesce(letters[w], '~')), '') AS read1,
   array_to_string(list_transform(around[spot : spot + greatest(stop2 - start, 0) - 1], lambda w: coalesce(letters[w], '~')), '') AS read2 FROM s0 LEFT JOIN v ON t = vt),
s1 AS (SELECT r.*, levenshtein(read1, code) <= levenshtein(read2, code) AS one, CASE WHEN one THEN read1 ELSE read2 END AS read, CASE WHEN base THEN i ELSE start END AS first,
   CASE WHEN base THEN i + {GRAM - 1} ELSE least(CASE WHEN one THEN stop1 ELSE stop2 END, len(words)) - 1 END AS last FROM r JOIN d USING (rid)),
s2 AS (SELECT *, levenshtein(read, code)::DOUBLE / n_t AS edits, CASE WHEN base THEN 1.0::DOUBLE ELSE held::DOUBLE / grams END AS share FROM s1),
s3 AS (SELECT *, row_number() OVER () AS id, base OR coalesce(edits <= {1 - ACCEPT:g} AND len(list_filter(keys, lambda k: NOT contains(read, k) OR contains(read, k || '!'))) = 0, false) AS verified FROM s2),
s4 AS (SELECT *, verified AND (base OR NOT EXISTS (SELECT 1 FROM s3 o WHERE o.rid = s3.rid AND o.verified AND NOT o.base AND o.label <> s3.label AND o.first <= s3.last AND o.last >= s3.first
   AND (o.edits < s3.edits OR o.edits = s3.edits AND o.t < s3.t))) AS accepted FROM s3),
f AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE accepted) AS labels,
   max(share) FILTER (WHERE accepted) AS score FROM s4 GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)
"""
