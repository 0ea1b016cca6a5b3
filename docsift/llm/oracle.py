"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from .licenses import CUE, LEAST, TEMPLATES, TERM
from .mixture import PIECE
from .secrets import ALLOWED, HEX_BITS, MIXED_BITS, SCALE, WINDOW, most

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
total AS (SELECT count(*) AS w, sum(size)::DOUBLE AS s FROM sizes WHERE size > 0),
rates AS (SELECT source, (s / w / size)::DOUBLE AS rate FROM sizes, total WHERE size > 0),
pieces AS (SELECT source, greatest(1, ceil(rate / {PIECE}))::INT AS pieces, rate / greatest(1, ceil(rate / {PIECE})) AS l FROM rates),
terms AS (SELECT *, list_transform(range(0, 121), lambda k: exp(-l + k * ln(l) - lgamma(k + 1))) AS p FROM pieces),
cdfs AS (SELECT *, list_transform(range(1, 122), lambda i: list_sum(p[1:i])) AS cdf FROM terms),
drawn AS (
  SELECT d.*, cdf, list_transform(range(1, pieces + 1), lambda k: ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT / 16.0 ** 13) AS u
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT * EXCLUDE (cdf, u), list_sum(list_transform(u, lambda x: len(list_filter(cdf, lambda c: c <= x)))) AS n FROM drawn),
copies AS (SELECT * EXCLUDE (n), unnest(range(0, n::INT))::INT AS copy FROM counted)
SELECT *, ('0x' || substr(md5('order:0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM copies
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: int, pattern: str, group: int, keep: str) -> str:
    p = _quote(pattern)
    return (
        f"SELECT rid, {kind} AS kind, unnest(m) AS val, unnest(g) AS grp, unnest(s[1:len(m)]) AS piece, generate_subscripts(m, 1) AS i, {keep} AS least "
        f"FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS s FROM d)"
    )


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_found(0, _ASSIGN, 2, "6")} UNION ALL {_found(1, "AKIA[A-Z0-9]+", 0, "20")} UNION ALL {_found(2, "[0-9a-f]+", 0, "24")}
  UNION ALL {_found(3, "[A-Za-z0-9+/_=-]+", 0, "20")}),
placed AS (SELECT *, sum(length(piece) + length(val)) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS stop FROM found),
spans AS (SELECT rid, kind, stop - length(val) AS start, stop, val FROM placed WHERE length(grp) >= least),
runs AS (
  SELECT rid, start, val, CASE WHEN regexp_full_match(val, '[0-9a-f]+|[0-9A-F]+') THEN {most(HEX_BITS, WINDOW)} ELSE {most(MIXED_BITS, WINDOW)} END AS most
  FROM spans WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
  {" ".join(f"AND NOT regexp_matches(val, {_quote(p)})" for p in ALLOWED)}),
windows AS (SELECT rid, start, most, o, substr(val, o + 1, {WINDOW}) AS win FROM (SELECT *, unnest(range(0, length(val) - {WINDOW} + 1)) AS o FROM runs)),
counts AS (SELECT rid, start, most, o, c, count(*) AS n FROM (SELECT *, unnest(string_split(win, '')) AS c FROM windows) GROUP BY ALL),
over AS (SELECT rid, start, o FROM counts GROUP BY rid, start, most, o HAVING sum(round(n * log2(n) * {SCALE})::BIGINT) <= most),
marked AS (SELECT *, CASE WHEN o <= lag(o) OVER (PARTITION BY rid, start ORDER BY o) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM over),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, start ORDER BY o) AS island FROM marked),
regions AS (SELECT rid, start + min(o) AS start, start + max(o) + {WINDOW} AS stop FROM islands GROUP BY rid, islands.start, island),
base AS (SELECT rid, kind, start, stop FROM spans WHERE kind < 3),
more AS (SELECT * FROM regions r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start <= r.start AND r.stop <= b.stop)),
named AS (SELECT rid, kind, start, stop, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS span
  FROM (SELECT * FROM base UNION ALL SELECT rid, 3, start, stop FROM more)),
per AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (rid)
"""

_TERMS = f"list_filter(list_transform(regexp_extract_all(lower(part), {_quote(TERM)}), lambda t: trim(t, '.')), lambda t: t <> '')"

OP4 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, (doc_id // 1000)::VARCHAR) AS dir,
    CASE WHEN len({_WORDS}) < 60 AND regexp_matches(coalesce(text, ''), '(?i)licen[cs]e') THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name FROM documents),
f AS (SELECT *, dir || '/' || name AS path, starts_with(name, 'LICENSE-') AS is_file FROM d),
parts AS (
  SELECT rid, 0 AS k, array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_quote(CUE)})), chr(10)) AS part FROM f WHERE regexp_matches(text, {_quote(CUE)})
  UNION ALL SELECT rid, 1, text FROM f WHERE is_file),
heads AS (SELECT rid, k, terms FROM (SELECT rid, k, {_TERMS} AS terms FROM parts) WHERE len(terms) > 0),
notices AS (SELECT * FROM (VALUES {", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in TEMPLATES.items())}) t(name, part)),
temps AS (SELECT name, {_TERMS} AS terms FROM notices),
known AS (SELECT DISTINCT unnest(terms) AS t FROM temps),
n AS (SELECT (SELECT count(*) FROM heads) + (SELECT count(*) FROM temps) AS n),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS t FROM heads UNION ALL SELECT unnest(list_distinct(terms)) FROM temps) WHERE t IN (SELECT t FROM known) GROUP BY t),
tf AS (SELECT rid, k, t, count(*) AS c FROM (SELECT rid, k, unnest(terms) AS t FROM heads) GROUP BY ALL),
vec AS (SELECT rid, k, t, (1 + ln(c)) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tf LEFT JOIN df USING (t), n),
tvec AS (SELECT name, t, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT name, t, count(*) AS c FROM (SELECT name, unnest(terms) AS t FROM temps) GROUP BY ALL) JOIN df USING (t), n),
norms AS (SELECT rid, k, sqrt(sum(w * w)) AS norm FROM vec GROUP BY ALL),
tnorms AS (SELECT name, sqrt(sum(w * w)) AS norm FROM tvec GROUP BY ALL),
dots AS (SELECT rid, k, name, sum(vec.w * tvec.w) AS dot FROM vec JOIN tvec USING (t) GROUP BY ALL),
scores AS (SELECT rid, name, round(dot / norms.norm / tnorms.norm, 6) AS score FROM dots JOIN norms USING (rid, k) JOIN tnorms USING (name)),
best AS (SELECT rid, score, name FROM scores QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, name) = 1),
own AS (SELECT f.*, coalesce(score, 0) AS score, CASE WHEN score >= {LEAST} THEN best.name END AS own FROM f LEFT JOIN best USING (rid)),
given AS (SELECT dir, own FROM own WHERE is_file AND own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) = 1),
near AS (SELECT a.dir, arg_max(g.own, length(g.dir)) AS inherited FROM (SELECT DISTINCT dir FROM own) a JOIN given g ON a.dir = g.dir OR starts_with(a.dir, g.dir || '/') GROUP BY a.dir)
SELECT doc_id, path, score, coalesce(own, inherited) AS license,
  CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS via
FROM own LEFT JOIN near USING (dir)
"""

_MARK = r"<\\*\|(im_start|im_sep|im_end)\|>"
_SAID = "<|im_end|><|im_start|>assistant ok"

OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
spoken AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  32 + length(role) + length(text) + len(regexp_extract_all(role, '{_MARK}')) + len(regexp_extract_all(text, '{_MARK}')) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM spoken GROUP BY conv_id
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
live AS (SELECT rid, doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL),
classes AS (SELECT k, min(doc_id) AS class_id, count(*) AS n_copies, any_value(n) AS n, any_value(s) AS s FROM live GROUP BY k),
items AS (SELECT class_id AS c, n, unnest(s) AS t, n_copies FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS i, any_value(a.n) AS an, any_value(b.n) AS bn, any_value(b.n_copies) AS copies FROM items a JOIN items b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c),
links AS (SELECT a, b, copies FROM pairs WHERE i >= 0.8 * (an + bn - i) - 1e-9),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
counts AS (SELECT a, sum(copies) AS n FROM links GROUP BY a),
per AS (SELECT rid, class_id, n_copies, n_copies - 1 + coalesce(counts.n, 0) AS n_links, group_id
  FROM live JOIN classes USING (k) JOIN groups ON groups.a = class_id LEFT JOIN counts ON counts.a = class_id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, doc_id) AS group_id
FROM d LEFT JOIN per USING (rid)
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT rid, doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (s) WHERE least < doc_id),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

SQL: dict[str, str] = {
    "op1_source_mixture": OP1,
    "op3_secrets": OP3,
    "op4_licenses": OP4,
    "op7_chat_format": OP7,
    "op8_jaccard_join": OP8,
    "op10_substring_dedup": OP10,
}
