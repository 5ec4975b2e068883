"""DuckDB twins of the registered log queries."""

from __future__ import annotations

from ..config import LEVELS
from ..functions.levels import ALIASES

#: 16 January 2024, and a week, in microseconds.
CUT_MICROS, WEEK_MICROS = 1_705_363_200_000_000, 7 * 86_400_000_000

# The default rules and the rules of personal data, written out here apart from the library's.
_RULES = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "<TS>"),
    (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b", "<IP>"),
    (r"\b0[xX][0-9a-fA-F]+\b", "<HEX>"),
    (r"(?:/[A-Za-z0-9_.-]+){2,}", "<PATH>"),
    (r"\b[0-9]+(?:\.[0-9]+)?\b", "<NUM>"),
)
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
_PHONE = r"\+(?:[1-9][0-9]{0,2}(?:[ .-]|[ .-]?\()(?:[ .()-]{0,2}[0-9]){6,13}|[1-9][0-9]{9,14})\b"
_ALL = "|".join(f"(?:{pattern})" for pattern, _ in _RULES)
_TOKEN = "CASE " + " ".join(f"WHEN regexp_full_match(h, '{pattern}') THEN '{token}'" for pattern, token in _RULES[:-1]) + f" WHEN h IS NOT NULL THEN '{_RULES[-1][1]}' ELSE '' END"


def masked(text: str) -> str:
    """The default rules in SQL."""
    gaps, hits = f"regexp_split_to_array({text}, '{_ALL}')", f"regexp_extract_all({text}, '{_ALL}')"
    tokens = f"list_transform({hits}, lambda h: {_TOKEN})"
    return f"array_to_string(list_transform(list_zip({gaps}, list_append({tokens}, '')), lambda z: z[1] || z[2]), '')"


def template(text: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array({masked(text)}, '[ \t\n\r]+'), lambda t: t <> ''), ' ')"


_MESSAGE = "event_type || ' user ' || user_id || ' value ' || cast(value AS decimal(18,2)) || ' props ' || props"
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
_EVENTS = f"e AS (SELECT event_id AS ord, {_MESSAGE} AS message, epoch_us(ts) AS us, {_LEVEL} AS level FROM events)"
_SHAPED = rf"s AS (SELECT *, translate(regexp_extract(message, 'user [0-9]*?([0-9]{{1,2}}) ', 1), '0123456789', 'abcdefghij') || ' ' || message AS busy FROM e)"
_TEMPLATES = f"t AS (SELECT *, {template('message')} AS text FROM e)"
_BUSY = f"t AS (SELECT *, {template('busy')} AS text FROM s)"
_LINES = r"l AS (SELECT doc_id * 134217728 + i - 1 AS ord, doc_id, i - 1 AS line_no, regexp_replace(w[i], '\r$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_FULL = r"f AS (SELECT * FROM l WHERE NOT regexp_full_match(line, '[ \t\n\x0C\r]*'))"
_ID = "substr(sha256(text), 1, 16)"
_RUNS = f"r AS (SELECT text, level, (us >= {CUT_MICROS})::INT AS run FROM t)"
_SIDES = (
    "c AS (SELECT text, count(*) FILTER (run = 0) AS b, count(*) FILTER (run = 1) AS a, count(*) FILTER (level = 'ERROR') AS ne, count(*) FILTER (level = 'WARN') AS nw FROM r GROUP BY text), "
    "n AS (SELECT count(*) FILTER (run = 0)::DOUBLE AS nb, count(*) FILTER (run = 1)::DOUBLE AS na FROM r), "
    "q AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN (a / na) / (b / nb) END AS ratio FROM c, n)"
)


def _cell(x: str, row: str, column: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln({x} * (nb + na) / (({row}) * ({column}))) ELSE 0 END"


_G = "2 * (" + " + ".join([_cell("b::DOUBLE", "b + a", "nb"), _cell("a::DOUBLE", "b + a", "na"), _cell("(nb - b)", "nb + na - b - a", "nb"), _cell("(na - a)", "nb + na - b - a", "na")]) + ")"
_SIDED = (
    f"{_LINES}, {_FULL}, k AS (SELECT doc_id % 2 AS side, {template('line')} AS text, count(*) AS n FROM f GROUP BY 1, 2), "
    "b AS (SELECT text, n FROM k WHERE side = 0 AND text NOT IN (SELECT text FROM k WHERE side = 1)), "
    "a AS (SELECT text, n FROM k WHERE side = 1 AND text NOT IN (SELECT text FROM k WHERE side = 0)), "
    r"bw AS (SELECT text, list_distinct(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda t: t <> '')) AS w FROM b), "
    r"aw AS (SELECT text, list_distinct(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda t: t <> '')) AS w FROM a)"
)
_PAIRS = (
    "be AS (SELECT text, unnest(w) AS x FROM bw), ae AS (SELECT text, unnest(w) AS x FROM aw), "
    "m AS (SELECT be.text AS before_text, ae.text AS after_text, count(*) AS c FROM be JOIN ae USING (x) GROUP BY 1, 2), "
    "p AS (SELECT m.*, len(bw.w) AS nb, len(aw.w) AS na FROM m JOIN bw ON bw.text = before_text JOIN aw ON aw.text = after_text)"
)
_VALUES = (
    r"v AS (SELECT ord, (us >= {cut})::INT AS run, text, unnest([{{'position': 2, 'value': regexp_extract(message, 'user ([0-9]+)', 1)}}, "
    r"{{'position': 4, 'value': regexp_extract(message, 'value -?([0-9]+(?:\.[0-9]+)?)', 1)}}, {{'position': 7, 'value': regexp_extract(message, '\x22: ([0-9]+)', 1)}}]) AS x FROM t), "
    "w AS (SELECT ord, run, text, x.position AS position, 'num' AS name, x.value AS value FROM v)"
).format(cut=CUT_MICROS)
_NUMBERS = "z AS (SELECT text, position, name, value::DOUBLE AS x FROM w)"
_UP = "greatest(ceil(ln(x) / ln(1.05)), -426)"

SQL = {
    "analyze_events_exact": f"WITH {_EVENTS}, {_TEMPLATES} SELECT {_ID} AS id, text, count(*) AS count, min(us) AS first, max(us) AS last, count(*) FILTER (level = 'INFO') AS n_info, count(*) FILTER (level = 'WARN') AS n_warn, count(*) FILTER (level = 'ERROR') AS n_error, CASE WHEN bool_or(level = 'ERROR') THEN 'ERROR' WHEN bool_or(level = 'WARN') THEN 'WARN' ELSE 'INFO' END AS level, arg_min(message, ord) AS example FROM t GROUP BY text",
    "mask_documents": f"WITH {_LINES} SELECT ord, {masked('line')} AS masked FROM l",
    "mask_pages": f"SELECT page_id, {masked('url')} AS url, sha256({masked('html')}) AS html FROM pages",
    "top20_templates_documents": f"WITH {_LINES}, {_FULL}, t AS (SELECT {template('line')} AS text FROM f) SELECT {_ID} AS id, text, count(*) AS count FROM t GROUP BY text ORDER BY count DESC, text LIMIT 20",
    "run_counters": f"WITH {_LINES}, {_FULL} SELECT (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM f) AS records, 0 AS unparsed",
    "time_window": f"WITH {_EVENTS} SELECT count(*) AS lines, count(*) FILTER (us >= {CUT_MICROS - WEEK_MICROS} AND us < {CUT_MICROS}) AS records, count(*) FILTER (NOT (us >= {CUT_MICROS - WEEK_MICROS} AND us < {CUT_MICROS})) AS out_of_range, count(*) FILTER (us IS NULL) AS untimed FROM e",
    "level_totals": f"WITH {_EVENTS} SELECT n AS level, count(e.level) AS records FROM (SELECT unnest({list(LEVELS)}) AS n) LEFT JOIN e ON level = n GROUP BY n",
    "level_filter": f"WITH {_EVENTS}, {_TEMPLATES} SELECT text, count(*) AS count, CASE WHEN bool_or(level = 'ERROR') THEN 'ERROR' ELSE 'WARN' END AS level FROM t GROUP BY text HAVING bool_or(level IN ('ERROR', 'WARN')) AND count(*) >= 2",
    "token_lengths": f"WITH {_LINES}, {_FULL}, t AS (SELECT {template('line')} AS text FROM f) SELECT CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n_tokens, count(*) AS records FROM t GROUP BY 1",
    "diff_split_at": f"WITH {_EVENTS}, {_SHAPED}, {_BUSY}, {_RUNS}, {_SIDES} SELECT {_ID} AS id, text, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN greatest(a, b) >= 5 AND greatest(ratio, 1 / ratio) >= 1.05 THEN 'changed' ELSE 'unchanged' END WHEN a > 0 THEN 'new' ELSE 'disappeared' END AS category, b AS before_count, a AS after_count, ratio, coalesce(greatest(ratio, 1 / ratio), 1.0) AS factor, CASE WHEN ne > 0 THEN 'ERROR' WHEN nw > 0 THEN 'WARN' ELSE 'INFO' END AS level FROM q",
    "diff_gtest": f"WITH {_EVENTS}, {_SHAPED}, {_BUSY}, {_RUNS}, {_SIDES}, g AS (SELECT text, greatest({_G}, 0) AS g FROM q WHERE a > 0 AND b > 0) SELECT text, CASE WHEN g >= 6.634896601021213 THEN 'changed' ELSE 'unchanged' END AS category, round(g, 4) AS score FROM g",
    "baseline_pooling": f"WITH {_EVENTS}, {_SHAPED}, {_BUSY}, w AS (SELECT text, us // {WEEK_MICROS} AS run FROM t), x AS (SELECT text, count(*) AS n, count(DISTINCT run) AS seen FROM w GROUP BY text) SELECT text, CASE WHEN seen = (SELECT count(DISTINCT run) FROM w) THEN n END AS count, seen = (SELECT count(DISTINCT run) FROM w) AS stable FROM x",
    "jaccard_pairs": f"WITH {_SIDED}, {_PAIRS} SELECT before_text, after_text, c / (nb + na - c) AS score FROM p WHERE c / (nb + na - c) >= 0.6",
    "overlap_pairs": f"WITH {_SIDED}, {_PAIRS} SELECT before_text, after_text, c / least(nb, na) AS score FROM p WHERE least(nb, na) >= 3 AND c / least(nb, na) >= 0.8",
    "idf_pairs": f"WITH {_SIDED}, {_PAIRS}, n AS (SELECT x, 1.0::DOUBLE / count(*) AS v FROM (SELECT * FROM be UNION ALL SELECT * FROM ae) GROUP BY x), i AS (SELECT be.text AS before_text, ae.text AS after_text, sum(v) AS s FROM be JOIN ae USING (x) JOIN n USING (x) GROUP BY 1, 2), bt AS (SELECT text, sum(v) AS v FROM be JOIN n USING (x) GROUP BY 1), av AS (SELECT text, sum(v) AS v FROM ae JOIN n USING (x) GROUP BY 1) SELECT before_text, after_text, round(s / (bt.v + av.v - s), 9) AS score FROM i JOIN bt ON bt.text = before_text JOIN av ON av.text = after_text WHERE s / (bt.v + av.v - s) >= 0.5",
    "subset_pairs": f"WITH {_EVENTS}, {_TEMPLATES}, c AS (SELECT text, count(*) AS n FROM t GROUP BY text), b AS (SELECT t AS text, row_number() OVER (ORDER BY n DESC, t) - 1 AS b FROM (SELECT regexp_replace(text, '^(click|view) ', '<*> ') AS t, n FROM c)), a AS (SELECT t AS text, row_number() OVER (ORDER BY n DESC, t) - 1 AS a FROM (SELECT replace(text, ' value <NUM>', ' value <*>') AS t, n FROM c)), z AS (SELECT b, a, string_split(b.text, ' ') AS x, string_split(a.text, ' ') AS y FROM b, a WHERE len(string_split(b.text, ' ')) = len(string_split(a.text, ' '))) SELECT b, a, abs(len(list_filter(x, lambda t: t = '<*>')) - len(list_filter(y, lambda t: t = '<*>'))) AS gap FROM z WHERE len(list_filter(list_zip(x, y), lambda p: p[1] <> '<*>' AND p[1] <> p[2])) = 0 OR len(list_filter(list_zip(x, y), lambda p: p[2] <> '<*>' AND p[1] <> p[2])) = 0",
    "value_distribution": f"WITH {_EVENTS}, {_TEMPLATES}, {_VALUES}, c AS (SELECT text, position, name, value, count(*) AS n, min(ord) AS o FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY text, position ORDER BY o, value) AS place FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY text, position ORDER BY place > 1000, n DESC, value) AS nth FROM k) SELECT text, position, name, string_agg(value || '=' || n, ';' ORDER BY nth) FILTER (nth <= 10 AND place <= 1000) AS top, least(count(*), 1000) AS n_distinct, count(*) > 1000 AS capped, coalesce(sum(n) FILTER (place > 1000), 0)::BIGINT AS other FROM r GROUP BY text, position, name",
    "numeric_summary": f"WITH {_EVENTS}, {_TEMPLATES}, {_VALUES}, {_NUMBERS} SELECT text, position, name, count(*) AS count, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean FROM z GROUP BY text, position, name",
    "numeric_quantiles": f"WITH {_EVENTS}, {_TEMPLATES}, {_VALUES}, {_NUMBERS}, y AS (SELECT *, row_number() OVER (PARTITION BY text, position ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY text, position) AS n, min(x) OVER (PARTITION BY text, position) AS low, max(x) OVER (PARTITION BY text, position) AS high, CASE WHEN x <= 1e-9 THEN 0.0 ELSE (pow(1.05, {_UP}) + pow(1.05, {_UP} - 1)) / 2 END AS mid FROM z) SELECT text, position, name, round(max(least(greatest(mid, low), high)) FILTER (k = floor(0.5 * (n - 1))), 6) AS p50, round(max(least(greatest(mid, low), high)) FILTER (k = floor(0.9 * (n - 1))), 6) AS p90, round(max(least(greatest(mid, low), high)) FILTER (k = floor(0.99 * (n - 1))), 6) AS p99 FROM y GROUP BY text, position, name",
    "new_gone_values": f"WITH {_EVENTS}, {_TEMPLATES}, {_VALUES}, both_runs AS (SELECT text FROM w GROUP BY text HAVING count(DISTINCT run) = 2), c AS (SELECT text, position, name, value, count(*) FILTER (run = 0) AS b, count(*) FILTER (run = 1) AS a FROM w WHERE text IN (SELECT text FROM both_runs) GROUP BY ALL), k AS (SELECT *, CASE WHEN b = 0 THEN 'new' WHEN a = 0 THEN 'gone' ELSE 'shared' END AS kind FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY text, position, kind ORDER BY a + b DESC, value) AS r FROM k) SELECT text, position, name, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (kind = 'gone') AS n_gone, count(*) FILTER (kind = 'shared') AS n_shared, coalesce(string_agg(value || '=' || (a + b), ';' ORDER BY r) FILTER (kind = 'new' AND r <= 10), '') AS new, coalesce(string_agg(value || '=' || (a + b), ';' ORDER BY r) FILTER (kind = 'gone' AND r <= 10), '') AS gone FROM o GROUP BY text, position, name HAVING count(*) FILTER (kind <> 'shared') > 0",
    "check_model": f"WITH {_EVENTS}, {_SHAPED}, {_BUSY}, {_RUNS}, x AS (SELECT text, count(*) FILTER (run = 0) > 0 AS known, count(*) FILTER (run = 1) AS n FROM r GROUP BY text) SELECT known, count(*) AS templates, sum(n)::BIGINT AS records FROM x WHERE n > 0 GROUP BY known",
    "match_exact_rule": f"WITH {_EVENTS}, {_TEMPLATES}, m AS (SELECT ord, CASE WHEN text = 'click user <NUM> value <NUM> props {{\"k\": <NUM>}}' THEN 1 WHEN regexp_full_match(text, '[^ ]+ user <NUM> value <NUM> props \\{{\"k\": <NUM>\\}}') THEN 0 WHEN regexp_full_match(text, 'view user <NUM> value [^ ]+ props \\{{\"k\": <NUM>\\}}') THEN 2 ELSE -1 END AS cluster FROM t) SELECT cluster, count(*) AS records, min(ord) AS first_ord FROM m GROUP BY cluster",
    "pii_mask_documents": f"WITH {_LINES}, p AS (SELECT ord, len(list_filter(regexp_extract_all(line, '{_EMAIL}|{_PHONE}'), lambda h: h LIKE '%@%')) AS emails, len(list_filter(regexp_extract_all(line, '{_EMAIL}|{_PHONE}'), lambda h: h NOT LIKE '%@%')) AS phones FROM l) SELECT * FROM p WHERE emails > 0 OR phones > 0",
    "json_parse": f"SELECT event_id AS ord, true AS good, event_type AS message, (epoch_us(ts) // 1000000) * 1000000 AS ts_micros, true AS tz_aware, {_LEVEL} AS level FROM events",
    "parse_app_lines": f"SELECT event_id AS ord, true AS good, {_MESSAGE} AS message, (epoch_us(ts) // 1000000) * 1000000 AS ts_micros, true AS tz_aware, {_LEVEL} AS level FROM events",
    "parse_access_lines": "SELECT event_id AS ord, true AS good, '\"GET /u/' || user_id || ' HTTP/1.1\" 200' AS message, (epoch_us(ts) // 1000000) * 1000000 - 7200000000 AS ts_micros, true AS tz_aware FROM events",
    "multiline_documents": f"WITH {_LINES}, {_FULL}, s AS (SELECT *, sum(regexp_matches(line, '^[A-M]')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS rec FROM f) SELECT min(ord) AS ord, count(*) AS n_lines, true AS good, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS message FROM s WHERE rec > 0 GROUP BY doc_id, rec UNION ALL SELECT ord, 1, false, sha256(line) FROM s WHERE rec = 0",
    "parse_levels": "WITH k AS (SELECT unnest({names}) AS name, unnest({values}) AS level, unnest(range({n})) AS i), c AS (SELECT event_id % {n} AS i, count(*) AS m FROM events GROUP BY 1), z AS (SELECT level, m FROM c JOIN k USING (i)) SELECT level, list_position({levels}, level) - 1 AS rank, coalesce(level IN ('WARN', 'ERROR', 'FATAL'), false) AS alert, sum(m)::BIGINT AS n FROM z GROUP BY level".format(
        names=[*ALIASES, "other", " warn "], values="[" + ", ".join(f"'{v}'" for v in ALIASES.values()) + ", NULL, 'WARN']", n=len(ALIASES) + 2, levels=list(LEVELS)
    ),
    "epochs": "SELECT event_id, s * 1000000 AS s, s * 1000000 + 7000 AS ms, s * 1000000 + 7 AS us, s * 1000000 + 7 AS ns FROM (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events)",
    "drain_train_events": f"WITH {_EVENTS}, {_TEMPLATES} SELECT {_ID} AS id, text, count(*) AS count, min(us) AS first, max(us) AS last, CASE WHEN bool_or(level = 'ERROR') THEN 'ERROR' WHEN bool_or(level = 'WARN') THEN 'WARN' ELSE 'INFO' END AS level, arg_min(message, ord) AS example FROM t GROUP BY text",
    "drain_recount_diff": f"WITH {_EVENTS}, {_TEMPLATES}, {_RUNS} SELECT text, 'unchanged' AS category, count(*) FILTER (run = 0) AS before_count, count(*) FILTER (run = 1) AS after_count FROM r GROUP BY text",
    "template_ids": "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS id FROM part",
}
