"""DuckDB's form of every query of :mod:`queries` that SQL can express, over the test tables."""

from ..functions.html import ENTITIES, REWRITES, SPACE
from ..functions.text import SEPARATOR, STOP_WORDS
from ..operators.collection import MAX_COUNT, MAX_DOC_TOKENS

_SEP = SEPARATOR.replace(r"\xA0\xB0", " °")
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '{_SEP}+'), lambda w: w <> '' AND NOT list_contains({_STOPS}, w))"


_CTES = {
    "docs_w": f"SELECT doc_id, {_words('text')} AS words FROM documents",
    "tokens": "SELECT doc_id, unnest(words) AS term, (generate_subscripts(words, 1) - 1)::BIGINT AS pos FROM docs_w",
    "doc_terms": "SELECT doc_id, term, count(*)::BIGINT AS n, min(pos) AS first FROM tokens GROUP BY ALL",
    "dictionary": f"SELECT (row_number() OVER (ORDER BY min(doc_id * 100000000 + first)) - 1)::BIGINT AS token_id, term, least(sum(n), {MAX_COUNT})::BIGINT AS tf, count(*) FILTER (WHERE first < {MAX_DOC_TOKENS})::BIGINT AS df FROM doc_terms GROUP BY term",
    "postings": f"SELECT token_id, doc_id FROM doc_terms JOIN dictionary USING (term) WHERE first < {MAX_DOC_TOKENS}",
    "whole_postings": "SELECT token_id, doc_id FROM doc_terms JOIN dictionary USING (term)",
    "bench": f"SELECT item_id AS query_id, text AS raw, {_words('text')} AS words FROM benchmark",
    "bench_terms": "SELECT query_id, pos, b.term, token_id FROM (SELECT query_id, unnest(words) AS term, (generate_subscripts(words, 1) - 1)::BIGINT AS pos FROM bench) b LEFT JOIN dictionary d ON b.term = d.term",
    "users": f"SELECT conv_id * 1000 + turn AS query_id, {_words('text')} AS words FROM conversations WHERE role = 'user'",
    "user_terms": "SELECT query_id, pos, b.term, token_id FROM (SELECT query_id, unnest(words) AS term, (generate_subscripts(words, 1) - 1)::BIGINT AS pos FROM users) b LEFT JOIN dictionary d ON b.term = d.term",
    "state": "SELECT q.query_id, count(t.pos)::BIGINT AS n_terms, coalesce(bool_and(t.pos IS NULL OR t.token_id IS NOT NULL), true) AS known FROM bench q LEFT JOIN bench_terms t USING (query_id) GROUP BY ALL",
    "asked": "SELECT DISTINCT query_id, token_id FROM bench_terms WHERE query_id IN (SELECT query_id FROM state WHERE known)",
    "hits": "SELECT query_id, doc_id FROM asked JOIN postings USING (token_id) GROUP BY query_id, doc_id HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.query_id = asked.query_id)",
    "pairs": "SELECT x.doc_id AS query_id, a.token_id AS t1, b.token_id AS t2 FROM (SELECT doc_id, words[(doc_id * 7) % len(words) + 1] AS w1, words[(doc_id * 13 + 5) % len(words) + 1] AS w2 FROM docs_w WHERE len(words) > 0) x JOIN dictionary a ON w1 = a.term JOIN dictionary b ON w2 = b.term",
    "pair_hits": "SELECT query_id, p1.doc_id FROM pairs JOIN postings p1 ON p1.token_id = t1 JOIN postings p2 ON p2.token_id = t2 AND p2.doc_id = p1.doc_id",
    "given": "SELECT DISTINCT doc_id, doc_id % 5 AS cluster_id FROM labels",
    "whole": "SELECT doc_id, doc_id % 7 AS cluster_id FROM documents",
    "clustered": "SELECT token_id, cluster_id, doc_id FROM postings JOIN given USING (doc_id)",
    "summed": "SELECT token_id, cluster_id, count(*)::BIGINT AS n FROM clustered GROUP BY ALL",
    "lengths": "SELECT query_id, cluster_id, sum(CASE WHEN side = 1 THEN n ELSE 0 END)::BIGINT AS l1, sum(CASE WHEN side = 2 THEN n ELSE 0 END)::BIGINT AS l2 FROM (SELECT query_id, t1 AS token_id, 1 AS side FROM pairs UNION ALL SELECT query_id, t2, 2 FROM pairs) JOIN summed USING (token_id) GROUP BY ALL",
    "totals": "SELECT p.query_id, coalesce(sum(l1), 0)::BIGINT AS total1, coalesce(sum(l2), 0)::BIGINT AS total2, coalesce(sum(least(l1, l2)), 0)::BIGINT AS min_sum, count(*) FILTER (WHERE l1 > 0 AND l2 > 0)::BIGINT AS n_both, count(*) FILTER (WHERE l1 > 0)::BIGINT AS n1, count(*) FILTER (WHERE l2 > 0)::BIGINT AS n2 FROM pairs p LEFT JOIN lengths USING (query_id) GROUP BY p.query_id",
    "grid": "SELECT query_id, c AS cluster_id, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, total1, total2 FROM totals CROSS JOIN range(0, (SELECT max(cluster_id) + 1 FROM given)) r(c) LEFT JOIN lengths l ON l.query_id = totals.query_id AND l.cluster_id = c".replace("SELECT query_id, c", "SELECT totals.query_id, c"),
    "factorials": "SELECT n, sum(CASE WHEN n = 0 THEN 0 ELSE ln(n) END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS lf FROM range(0, (SELECT max(total1 + total2) + 1 FROM totals)) r(n)",
    "held": "SELECT token_id, doc_id FROM postings WHERE doc_id IN (SELECT doc_id FROM given)",
    "labelled": "SELECT doc_id, cluster_id, (row_number() OVER (ORDER BY cluster_id, doc_id) - 1)::BIGINT AS new_id FROM given",
    "gaps": "SELECT token_id, (row_number() OVER w - 1)::BIGINT AS nth, doc_id - lag(doc_id, 1, -1) OVER w AS gap FROM held WINDOW w AS (PARTITION BY token_id ORDER BY doc_id)",
    "new_gaps": "SELECT token_id, (row_number() OVER w - 1)::BIGINT AS nth, new_id - lag(new_id, 1, -1) OVER w AS gap FROM held JOIN labelled USING (doc_id) WINDOW w AS (PARTITION BY token_id ORDER BY new_id)",
    "weights": "SELECT token_id, tf AS w FROM dictionary",
    "assign8": "SELECT doc_id, doc_id % 8 AS cluster_id FROM docs_w",
    "centers": "SELECT cluster_id, token_id, count(*)::BIGINT AS c FROM postings JOIN assign8 USING (doc_id) GROUP BY ALL",
    "cfreq": "SELECT token_id, count(*)::BIGINT AS cf FROM centers GROUP BY ALL",
    "above": "SELECT cluster_id, c, (sum(w) OVER (PARTITION BY cluster_id ORDER BY c DESC ROWS UNBOUNDED PRECEDING) - w)::BIGINT AS p FROM (SELECT cluster_id, c, sum(w) AS w FROM centers JOIN weights USING (token_id) GROUP BY ALL)",
    "above_cf": "SELECT cf, (sum(w) OVER (ORDER BY cf DESC ROWS UNBOUNDED PRECEDING) - w)::BIGINT AS cp FROM (SELECT cf, sum(w) AS w FROM cfreq JOIN weights USING (token_id) GROUP BY ALL)",
    "mass": "SELECT cluster_id, sum(w)::BIGINT AS m FROM centers JOIN weights USING (token_id) GROUP BY ALL",
    "cps": "SELECT token_id, cp FROM cfreq JOIN above_cf USING (cf)",
    "scored": """SELECT d.doc_id, d.doc_id AS idx, k.cluster_id, coalesce(s.score, 0)::BIGINT AS score FROM docs_w d CROSS JOIN (SELECT c AS cluster_id FROM range(0, 8) r(c)) k LEFT JOIN (
        SELECT p.doc_id, k.cluster_id, sum(w * (coalesce(a.p, m.m) + CASE WHEN c.c IS NULL THEN cp ELSE 0 END)) AS score
        FROM postings p JOIN weights USING (token_id) JOIN cps USING (token_id) CROSS JOIN (SELECT c AS cluster_id FROM range(0, 8) r(c)) k JOIN mass m ON m.cluster_id = k.cluster_id
        LEFT JOIN centers c ON c.cluster_id = k.cluster_id AND c.token_id = p.token_id LEFT JOIN above a ON a.cluster_id = c.cluster_id AND a.c = c.c GROUP BY ALL) s
        ON s.doc_id = d.doc_id AND s.cluster_id = k.cluster_id""",
}


def _needed(sql: str, seen: dict) -> None:
    import re

    for name, body in _CTES.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(body, seen)
            seen[name] = body


def _query(sql: str) -> str:
    seen: dict[str, str] = {}
    _needed(sql, seen)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in seen.items()) + "\n" if seen else "") + sql


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _html(page: str) -> str:
    out = f"regexp_replace({page}, '{SPACE}', ' ', 'g')".replace(r"\xA0", " ").replace(r"\x0B", "\\x0B")
    for pattern, text in REWRITES:
        out = f"regexp_replace({out}, '(?s){pattern}', '{text}', 'g')"
    for name, c in ENTITIES.items():
        out = f"replace({out}, '&{name};', '{_quoted(c)}')"
    return f"replace({out}, '&amp;', '&')"


_L2 = "(ln({}) / 0.6931471805599453)"


def _codes(table: str) -> str:
    """Sizes of gaps under all codes, a row for each token."""
    lg = _L2.format
    approx, gamma = f"2 + ceil({lg('gap')})", f"1 + 2 * floor({lg('gap')})"
    delta = f"1 + 2 * floor({_L2.format(lg('2 * gap'))}) + floor({lg('gap')})"

    def golomb(b):
        q = f"((gap - 1) // {b})"
        return f"({q} + 1 + CASE WHEN gap - {q} * {b} - 1 < pow(2.0, floor({lg(b)}) - 1) THEN floor({lg(b)}) ELSE ceil({lg(b)}) END)"

    def factor(part):
        return f"greatest(2, round_even(sum(gap) OVER ({part}) / count(*) OVER ({part}) * 0.6931471805599453, 0)::BIGINT)"

    params = ", ".join([f"{factor('PARTITION BY token_id')} AS b0", *(f"{factor(f'PARTITION BY token_id, nth // {b}')} AS b{b}" for b in (8, 16, 32, 64))])
    header = "CASE WHEN nth % {0} = 0 THEN 1 + 2 * floor(" + lg("(b{0} - 1)") + ") ELSE 0 END"
    sums = ", ".join([f"sum({approx})::BIGINT AS approx", f"sum({gamma})::BIGINT AS gamma", f"sum({delta})::BIGINT AS delta", f"sum({golomb('b0')})::BIGINT AS golomb", *(f"sum({golomb(f'b{b}')} + {header.format(b)})::BIGINT AS hybrid_{b}" for b in (8, 16, 32, 64))])
    return f"SELECT token_id, count(*)::BIGINT AS size, {sums} FROM (SELECT *, {params} FROM {table}) GROUP BY token_id"


_NAMES = ["approx", "gamma", "delta", "golomb", "hybrid_8", "hybrid_16", "hybrid_32", "hybrid_64"]
_LOGC = "floor(s.lf - y.lf - x.lf)::BIGINT"


def _logc(x: str, y: str) -> str:
    f = "(SELECT lf FROM factorials WHERE n = {})"
    return f"floor({f.format(f'{x} + {y}')} - {f.format(y)} - {f.format(x)})::BIGINT"


_SQL = {
    # text
    "tokenize": "SELECT doc_id, pos, term FROM tokens",
    "separator_counts": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_SEP}'))::BIGINT AS n_separators FROM documents",
    "stop_word_counts": f"SELECT doc_id, len(list_filter(string_split_regex(replace(lower(coalesce(text, '')), 'ß', 'ss'), '{_SEP}+'), lambda w: w <> ''))::BIGINT AS n_words, len(list_filter(string_split_regex(replace(lower(coalesce(text, '')), 'ß', 'ss'), '{_SEP}+'), lambda w: list_contains({_STOPS}, w)))::BIGINT AS n_stop FROM documents",
    "longer_than": "SELECT doc_id, len(words) > 300 AS longer, true AS always FROM docs_w",
    "distinct_terms": "SELECT d.doc_id, coalesce(string_agg(token_id::VARCHAR, ',' ORDER BY token_id), '') AS tokens FROM docs_w d LEFT JOIN postings USING (doc_id) GROUP BY d.doc_id",
    # sources
    "sentence_docs": f"""SELECT doc_id, "offset", length(piece)::BIGINT AS length, piece AS text FROM (
        SELECT doc_id, piece, (coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
        FROM (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS nth FROM (SELECT doc_id, string_split_regex(text, '[!.?]') AS s FROM documents))) WHERE len({_words('piece')}) > 1""",
    "sentence_fragments": f"""SELECT doc_id, "offset", piece AS text FROM (
        SELECT doc_id, piece, (coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
        FROM (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS nth FROM (SELECT doc_id, string_split_regex(text, '[!.?]') AS s FROM documents))) WHERE len({_words('piece')}) > 1""",
    "length_delimited_docs": 'SELECT doc_id, 4::BIGINT AS "offset", strlen(text)::BIGINT AS length, text FROM documents UNION ALL SELECT doc_id, 8 + strlen(text), strlen(source), source FROM documents',
    "length_delimited_gzip_docs": 'SELECT doc_id, 4::BIGINT AS "offset", strlen(text)::BIGINT AS length, text FROM documents UNION ALL SELECT doc_id, 8 + strlen(text), strlen(source), source FROM documents',
    "archive_page_docs": f"""SELECT page_id, (CASE n WHEN 0 THEN 0 ELSE length(html) + 35 END)::BIGINT AS "offset", (CASE n WHEN 0 THEN length(html) + 35 ELSE length(url) + 35 END)::BIGINT AS length, CASE n WHEN 0 THEN {_html('html')} ELSE {_html('url')} END AS text FROM pages CROSS JOIN range(0, 2) r(n)""",
    "html_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "whitespace_collapse": f"SELECT page_id, regexp_replace(html, '{SPACE}', ' ', 'g') AS text FROM pages".replace(r"\xA0", " "),
    "query_log": "SELECT query_id, raw FROM bench",
    "documents_by_id": "SELECT i.item_id AS ord, d.doc_id, d.text FROM (SELECT item_id, item_id * 3 % 50 AS doc_id FROM benchmark) i JOIN documents d USING (doc_id)",
    "document_metadata": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17",
    # sinks
    "saved_collection": f"SELECT (SELECT count(*) FROM docs_w) AS n_docs, (SELECT count(*) FROM dictionary) AS n_terms, (SELECT count(*) FROM postings) AS n_postings, (SELECT sum(least(len(words), {MAX_DOC_TOKENS})) FROM docs_w)::BIGINT AS n_stored",
    "saved_index": "SELECT token_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM postings WHERE token_id % 10 = 3 GROUP BY token_id",
    "cluster_index_files": "SELECT token_id, doc_id FROM clustered WHERE cluster_id = 2",
    "report_lines": "SELECT concat_ws(chr(9), query_id, least(total1, total2), greatest(total1, total2), least(total1, total2), min_sum, least(n1, n2)) AS line FROM totals",
    # dictionary and statistics
    "dictionary": "SELECT token_id, term FROM dictionary",
    "dictionary_round_trip": "SELECT token_id, term, token_id AS again FROM dictionary",
    "dictionary_growth": "SELECT token_id, term FROM dictionary UNION ALL SELECT (SELECT count(*) FROM dictionary) + row_number() OVER (ORDER BY min(query_id * 100000 + pos)) - 1, term FROM user_terms WHERE token_id IS NULL GROUP BY term",
    "term_freq": "SELECT token_id, tf FROM dictionary",
    "doc_term_freq": "SELECT doc_id, token_id, n FROM doc_terms JOIN dictionary USING (term)",
    "query_log_counts": "SELECT d.token_id, count(u.pos)::BIGINT AS n FROM dictionary d LEFT JOIN user_terms u ON u.token_id = d.token_id GROUP BY d.token_id",
    "term_probabilities": "SELECT d.token_id, round(any_value(tf) / (SELECT sum(tf) FROM dictionary), 12) AS p_tf, round(count(u.pos) / (SELECT count(*) FROM user_terms WHERE token_id IS NOT NULL), 12) AS p_log FROM dictionary d LEFT JOIN user_terms u ON u.token_id = d.token_id GROUP BY d.token_id",
    "collection_stats": f"""SELECT (SELECT count(*) FROM docs_w) AS n_docs, round((SELECT avg(least(len(words), {MAX_DOC_TOKENS})) FROM docs_w), 6) AS avg_doc_length, count(*) AS n_terms, round(avg(tf), 6) AS avg_tf,
        max(tf) FILTER (WHERE r = n // 2) AS median_tf, max(tf) AS max_tf, sum(tf)::BIGINT AS total_tf, {', '.join(f'(sum(tf) FILTER (WHERE r < {t}))::BIGINT AS sum_top_{t}' for t in (1000, 10_000, 100_000, 1_000_000))}
        FROM (SELECT tf, row_number() OVER (ORDER BY tf DESC) - 1 AS r, count(*) OVER () AS n FROM dictionary)""",
    "collection_bounds": "SELECT (SELECT count(*) FROM docs_w) AS collection_size, (SELECT max(doc_id) FROM docs_w) AS max_doc_id, (SELECT count(*) FROM dictionary) AS dictionary_size",
    "doc_freq": "SELECT d.token_id, count(p.doc_id)::BIGINT AS df FROM dictionary d LEFT JOIN postings p USING (token_id) GROUP BY d.token_id",
    "top_terms_low_id": "SELECT token_id, tf AS w FROM dictionary ORDER BY tf DESC, token_id LIMIT 1000",
    "top_terms_high_id": "SELECT token_id, tf AS w FROM dictionary ORDER BY tf DESC, token_id DESC LIMIT 1000",
    "token_documents": f"SELECT d.doc_id, coalesce(string_agg(token_id::VARCHAR, ',' ORDER BY pos), '') AS tokens FROM docs_w d LEFT JOIN (SELECT doc_id, pos, token_id FROM tokens JOIN dictionary USING (term) WHERE pos < {MAX_DOC_TOKENS}) USING (doc_id) GROUP BY d.doc_id",
    # index
    "postings": "SELECT token_id, doc_id FROM postings",
    "postings_packed": "SELECT token_id, count(*)::BIGINT AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM postings GROUP BY token_id",
    "index_from_lists": "SELECT DISTINCT conv_id AS key, length(text) % 10 AS value FROM conversations",
    "posting_lists": "SELECT p.token_id, p.doc_id FROM postings p WHERE p.token_id IN (SELECT token_id FROM bench_terms)",
    "index_keys": "SELECT d.token_id, count(p.doc_id)::BIGINT AS size FROM dictionary d LEFT JOIN postings p USING (token_id) GROUP BY d.token_id",
    "index_union": "SELECT token_id, doc_id FROM postings",
    "doc_limit": "SELECT token_id, doc_id FROM postings WHERE doc_id < 100",
    "doc_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id LIMIT 100",
    "clustered_postings": "SELECT token_id, doc_id FROM held",
    "restricted_terms": "SELECT doc_id, token_id, local_id FROM postings JOIN (SELECT token_id, (row_number() OVER (ORDER BY token_id) - 1)::BIGINT AS local_id FROM (SELECT token_id FROM dictionary ORDER BY tf DESC, token_id LIMIT 500)) USING (token_id)",
    # search
    "lookup_words": "SELECT query_id, pos, term, token_id FROM bench_terms",
    "resolve_queries": "SELECT s.query_id, s.n_terms, s.known, CASE WHEN s.known THEN coalesce(string_agg(t.token_id::VARCHAR, ',' ORDER BY t.pos), '') END AS tokens FROM state s LEFT JOIN bench_terms t ON t.query_id = s.query_id GROUP BY s.query_id, s.n_terms, s.known",
    "and_search_2": "SELECT query_id, doc_id FROM pair_hits",
    "and_search_k": "SELECT query_id, doc_id FROM hits",
    "lookup_intersect": "SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM pair_hits GROUP BY query_id",
    "sharded_search": "SELECT query_id, p1.doc_id FROM pairs JOIN whole_postings p1 ON p1.token_id = t1 JOIN whole_postings p2 ON p2.token_id = t2 AND p2.doc_id = p1.doc_id",
    "search_report": "SELECT s.query_id, CASE WHEN NOT known THEN 'unknown terms' WHEN n_terms = 0 THEN 'empty or only stop words' ELSE 'ok' END AS status, count(doc_id)::BIGINT AS n_docs, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE r <= 3), '') AS first_docs FROM state s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM hits) USING (query_id) GROUP BY s.query_id, known, n_terms",
    "query_filter": "SELECT query_id, raw FROM bench JOIN state USING (query_id) WHERE n_terms >= 5 AND n_terms <= 40 AND (SELECT count(*) FROM hits h WHERE h.query_id = bench.query_id) >= 2",
    "pair_queries": "SELECT query_id, t1, t2 FROM pairs",
    "query_pairs_exact2": "SELECT query_id, min_by(token_id, pos) AS t1, max_by(token_id, pos) AS t2 FROM (SELECT query_id, token_id, min(pos) AS pos FROM (SELECT query_id, pos, token_id FROM user_terms WHERE pos < 3) WHERE token_id IS NOT NULL GROUP BY ALL) GROUP BY query_id HAVING count(*) = 2",
    "query_pairs_expand": "SELECT a.query_id, a.token_id AS t1, b.token_id AS t2 FROM bench_terms a JOIN bench_terms b ON a.query_id = b.query_id AND a.token_id < b.token_id WHERE a.query_id IN (SELECT query_id FROM state WHERE known)",
    "query_pairs_single": "SELECT a.query_id, a.token_id AS t1, b.token_id AS t2 FROM user_terms a JOIN user_terms b ON a.query_id = b.query_id AND a.token_id < b.token_id WHERE a.pos < 2 AND b.pos < 2",
    # clusterings
    "cluster_members": "SELECT doc_id FROM given WHERE cluster_id = 3",
    "cluster_bounds": "SELECT max(doc_id) AS max_doc_id, max(cluster_id) AS max_cluster_id, count(*) AS n_docs, count(DISTINCT cluster_id) AS n_clusters FROM given",
    "cluster_size_list": "SELECT c AS cluster_id, count(doc_id)::BIGINT AS size FROM range(0, (SELECT max(cluster_id) + 1 FROM given)) r(c) LEFT JOIN given ON cluster_id = c GROUP BY c",
    "cluster_mapping": "SELECT d.doc_id, cluster_id FROM docs_w d LEFT JOIN given g ON d.doc_id = g.doc_id",
    "relabel": "SELECT doc_id, cluster_id, new_id FROM labelled",
    "relabel_pow2": """SELECT doc_id, cluster_id, (r * nth + (rnk * r) // len)::BIGINT AS new_id FROM (SELECT doc_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) - 1 AS rnk FROM whole)
        JOIN (SELECT cluster_id, count(*) AS len, row_number() OVER (ORDER BY cluster_id) - 1 AS nth, pow(2, ceil(log2(max(count(*)) OVER ())))::BIGINT AS r FROM whole GROUP BY cluster_id) USING (cluster_id)""",
    "without_empty_clusters": "SELECT doc_id, (dense_rank() OVER (ORDER BY doc_id % 3) - 1)::BIGINT AS cluster_id FROM given",
    "cluster_postings_index": "SELECT token_id, cluster_id, doc_id FROM clustered",
    "cluster_list_sizes": "SELECT token_id, count(*)::BIGINT AS size FROM clustered GROUP BY token_id",
    "cluster_intersect": "SELECT query_id, cluster_id, doc_id FROM pair_hits JOIN given USING (doc_id)",
    "term_cluster_sizes": "SELECT t.token_id, c AS cluster_id, coalesce(n, 0) AS n FROM (SELECT token_id FROM dictionary ORDER BY tf DESC, token_id DESC LIMIT 200) t CROSS JOIN range(0, (SELECT max(cluster_id) + 1 FROM given)) r(c) LEFT JOIN summed s ON s.token_id = t.token_id AND s.cluster_id = c",
    "cluster_sizes_report": "SELECT t.token_id, t.w, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY coalesce(n, 0) DESC) AS sizes FROM (SELECT token_id, tf AS w FROM dictionary ORDER BY tf DESC, token_id DESC LIMIT 1000) t CROSS JOIN range(0, (SELECT max(cluster_id) + 1 FROM given)) r(c) LEFT JOIN summed s ON s.token_id = t.token_id AND s.cluster_id = c GROUP BY ALL",
    # complexity
    "cluster_lengths": "SELECT query_id, cluster_id, l1, l2 FROM lengths",
    "query_lengths": "SELECT * FROM totals",
    "cost_functions": "SELECT query_id, least(total1, total2) AS min_cost, round(CASE WHEN least(total1, total2) = 0 THEN 0 ELSE least(total1, total2) * (400 - 350 * (least(total1, total2) / greatest(total1, total2))) END, 6) AS cache_cost, round(CASE WHEN least(total1, total2) = 0 THEN 0 ELSE least(total1, total2) * ln(least(total1, total2) / greatest(total1, total2)) END, 6) + 0.0 AS log_cost FROM totals",
    "query_speedups": "SELECT query_id, least(total1, total2) AS total_cost, min_sum AS list_cost, min_sum + least(n_both, 5) AS cluster_cost, n_both, round(CASE WHEN min_sum + least(n_both, 5) = 0 THEN 1 ELSE least(total1, total2) / (min_sum + least(n_both, 5)) END, 9) AS speedup FROM totals",
    "speedup_report": """SELECT count(*) AS n_queries, round(avg(CASE WHEN cc = 0 THEN 1 ELSE tc / cc END), 6) AS avg_speedup, round(CASE WHEN sum(cc) = 0 THEN 1 ELSE sum(tc) / sum(cc) END, 6) AS total_speedup,
        round(CASE WHEN sum(lc) = 0 THEN 1 ELSE sum(tc) / sum(lc) END, 6) AS list_speedup, sum(tc)::BIGINT AS total_cost, sum(cc)::BIGINT AS cluster_cost, round(avg(n_both), 6) AS avg_clusters
        FROM (SELECT least(total1, total2) AS tc, min_sum AS lc, min_sum + least(n_both, 5) AS cc, n_both FROM totals)""",
    "ratio_report": "SELECT query_id, cluster_id, round(CASE WHEN total1 > total2 THEN CASE WHEN l1 = 0 THEN 0 ELSE l2 / l1 END ELSE CASE WHEN l2 = 0 THEN 0 ELSE l1 / l2 END END, 9) AS ratio FROM (SELECT query_id, cluster_id, l1, l2, total1, total2 FROM grid UNION ALL SELECT query_id, -1, total1, total2, total1, total2 FROM totals)",
    "sizes_report": "SELECT query_id, any_value(total1 || '/' || total2) AS total, string_agg(l1 || '/' || l2, ',' ORDER BY cluster_id) AS clusters FROM grid GROUP BY query_id",
    "bench_sizes_min": "SELECT query_id, least(total1, total2) AS size_small, greatest(total1, total2) AS size_big, least(total1, total2) AS normal_comp, min_sum AS intersect_comp, least(n1, n2) AS cluster_comp FROM totals",
    "bench_sizes_log": f"SELECT query_id, least(total1, total2) AS size_small, greatest(total1, total2) AS size_big, {_logc('total1', 'total2')} AS normal_comp, coalesce((SELECT sum(c) FROM (SELECT query_id AS q, {_logc('l1', 'l2')} AS c FROM lengths) e WHERE e.q = totals.query_id), 0)::BIGINT AS intersect_comp, {_logc('n1', 'n2')} AS cluster_comp FROM totals",
    "bench_result_sizes": "SELECT p.query_id, count(h.doc_id)::BIGINT AS normal_size, count(h.doc_id)::BIGINT AS relabeled_size, count(h.doc_id)::BIGINT AS cluster_size FROM pairs p LEFT JOIN (SELECT * FROM pair_hits WHERE doc_id IN (SELECT doc_id FROM given)) h USING (query_id) GROUP BY p.query_id",
    # compression
    "deltas": "SELECT token_id, nth, gap FROM gaps",
    "code_bits": _codes("gaps"),
    "code_bits_relabeled": _codes("new_gaps"),
    "golomb_factors": "SELECT token_id, greatest(2, round_even(sum(gap) / count(*) * 0.6931471805599453, 0)::BIGINT) AS b FROM gaps GROUP BY token_id",
    "integer_codes": f"SELECT x, (2 + ceil({_L2.format('x')}))::BIGINT AS approx, (1 + 2 * floor({_L2.format('x')}))::BIGINT AS gamma, (1 + 2 * floor({_L2.format(_L2.format('2 * x'))}) + floor({_L2.format('x')}))::BIGINT AS delta FROM (SELECT doc_id + 1 AS x FROM documents)",
    "compression_report": f"SELECT d.token_id, coalesce(a.size, 0) AS size, {', '.join(f'coalesce(a.{c}, 0) AS normal_{c}' for c in _NAMES)}, {', '.join(f'coalesce(b.{c}, 0) AS cluster_{c}' for c in _NAMES)} FROM dictionary d LEFT JOIN ({_codes('gaps')}) a ON a.token_id = d.token_id LEFT JOIN ({_codes('new_gaps')}) b ON b.token_id = d.token_id",
    # clustering rounds
    "fmf_centers": "SELECT cluster_id, token_id, c FROM centers",
    "fmf_cfreq": "SELECT token_id, cf FROM cfreq",
    "fmf_prefix_sum": "SELECT cluster_id, token_id, c AS v, p FROM centers JOIN above USING (cluster_id, c)",
    "fmf_score": "SELECT doc_id, cluster_id, score FROM scored",
    "fmf_assign_round": "SELECT doc_id, cluster_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, (cluster_id - idx % 8 + 8) % 8) AS r FROM scored) WHERE r = 1",
}

ORACLE_SQL = {name: _query(sql) for name, sql in _SQL.items()}
