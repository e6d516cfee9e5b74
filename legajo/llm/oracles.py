"""DuckDB SQL with the rows of the llm queries that SQL can express on small tables."""

from __future__ import annotations

import re

from legajo.llm.chat_format import CONTENT, CONTROL, END, TURN
from legajo.llm.quality_rules import COMMON, MAX_CLASS, MAX_COMMON, MIN_CHARS, MIN_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
hits AS (SELECT doc_id, p, win.k, item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') s
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) t(p)) x JOIN win ON x.k = win.k AND x.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT i) n FROM hits, unnest(range(p, p + k)) t(i) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(covered.n, 0) n_hit, coalesce(named.n, 0) n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_FIRSTS = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_MARKS = len(TURN) + len(CONTENT) + len(END)


def _escaped(x: str) -> str:
    """Length of an escaped text: one backslash more for each control string."""
    return rf"length({x}) + len(regexp_extract_all({x}, '[{_FIRSTS}]\\*(?:{_TAILS})'))"


OP2 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) loss_sha256,
  CAST(sum({_MARKS} + {_escaped("r")} + {_escaped("x")}) AS BIGINT) formatted_chars
FROM t GROUP BY conv_id
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a doc_id, b other FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT doc_id, min(other) m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') s FROM d, unnest(range(1, len(w) - 18)) t(p)),
late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
word AS (SELECT doc_id, i, w[i] x FROM d, unnest(range(1, len(w) + 1)) t(i)),
flag AS (SELECT word.doc_id, i, x, max(CASE WHEN p IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY word.doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) gone
  FROM word LEFT JOIN late ON late.doc_id = word.doc_id AND late.p = i),
sums AS (SELECT doc_id, count(*) n, CAST(sum(gone) AS BIGINT) g, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) k FROM flag GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) n_words, coalesce(g, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) tx, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, tx) - 1 k, greatest(1, CAST(floor(sqrt(size::DOUBLE) * 1024) AS BIGINT)) w FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 sid FROM s),
v AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END weight, 2 * source_size cap FROM o),
f AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM v),
g AS (SELECT level FROM f WHERE level * weight <= cap ORDER BY cap / weight, sid LIMIT 1),
t AS (SELECT source, sid, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM g) * weight, cap::DOUBLE)) target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size rest FROM t),
h AS (SELECT sid, rest, w, sum(size) words, sum(size * w) mass FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY sid, rest, w),
i AS (SELECT sid, w, (rest - coalesce(sum(words) OVER (PARTITION BY sid ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(mass) OVER (PARTITION BY sid ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE c FROM h),
l AS (SELECT sid, arg_max(c, w) c FROM i WHERE c * w < 1 GROUP BY sid),
u AS (SELECT n.*, p.* EXCLUDE (source), (CAST('0x' || substr(md5('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || tx || ':' || k), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 x,
    least(1.0, w * coalesce(c, 1.0)) pi FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source LEFT JOIN l USING (sid)),
q AS (SELECT *, CASE WHEN pi >= 1 THEN 0.0 WHEN pi > 0 THEN (x / (1 - x)) * ((1 - pi) / pi) ELSE x / (1 - x) END pareto FROM u),
c AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY pareto, doc_id, tx, k ROWS UNBOUNDED PRECEDING) run FROM q),
had AS (SELECT sid, coalesce(max(CASE WHEN run <= rest AND size > 0 THEN run END), 0) had FROM c GROUP BY sid),
more AS (SELECT c.sid, doc_id, tx, k FROM c JOIN had USING (sid) WHERE run > rest AND size > 0 AND abs(rest - had - size) < rest - had
  QUALIFY row_number() OVER (PARTITION BY c.sid ORDER BY abs(rest - had - size), pareto, doc_id, tx, k) = 1)
SELECT c.doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN run <= rest OR more.tx IS NOT NULL THEN 1 ELSE 0 END) END AS BIGINT) taken
FROM c LEFT JOIN more ON more.sid = c.sid AND more.doc_id IS NOT DISTINCT FROM c.doc_id AND more.tx = c.tx AND more.k = c.k
"""



def _entropy(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda v: CASE WHEN v > 0 THEN -v * log2(v) ELSE 0 END))"


def _distance(p: str, q: str) -> str:
    middle = f"list_transform(range(1, len({p}) + 1), lambda i: ({p}[i] + {q}[i]) / 2)"
    return f"round(sqrt(greatest(0, {_entropy(middle)} - ({_entropy(p)} + {_entropy(q)}) / 2)), 6)"


def _shares(x: str) -> str:
    return f"list_transform({x}, lambda v: CASE WHEN list_sum({x}) > 0 THEN v::DOUBLE / list_sum({x}) ELSE 0 END)"


OP9 = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w FROM documents),
word AS (SELECT lang, unnest(w) x FROM d),
top AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) k FROM word GROUP BY lang, x QUALIFY k <= {COMMON}),
common AS (SELECT lang, list(x ORDER BY k) c FROM top GROUP BY lang),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) n FROM d, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT r, count(DISTINCT j) n FROM tri, unnest([i, i + 1, i + 2]) v(j) WHERE n > 1 GROUP BY r),
a AS (SELECT *, regexp_replace(t, '\p{{L}}+', '', 'g') rest, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) chars,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
b AS (SELECT *, length(rest) - length(regexp_replace(rest, '\p{{Nd}}+', '', 'g')) dig, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) up,
  len(regexp_extract_all(t, '[#*$%&|<>]')) sym FROM a),
f AS (SELECT b.*, coalesce(rep.n, 0) n_repeat, [length(t) - length(rest) - up, up, dig, length(t) - chars, sym, length(rest) - dig - (length(t) - chars) - sym] cls,
  list_transform(coalesce(c, []), lambda y: len(list_filter(w, lambda x: x = y))) h0
  FROM b LEFT JOIN rep USING (r) LEFT JOIN common ON common.lang IS NOT DISTINCT FROM b.lang),
g AS (SELECT *, list_append(h0, len(w) - coalesce(list_sum(h0), 0)) h FROM f),
refs AS (SELECT lang, list(s ORDER BY i) q_cls FROM (SELECT lang, i, sum(cls[i]) s FROM g, unnest(range(1, 7)) u(i) GROUP BY lang, i) GROUP BY lang),
refh AS (SELECT lang, list(s ORDER BY i) q_h FROM (SELECT lang, i, sum(h[i]) s FROM g, unnest(range(1, len(h) + 1)) u(i) GROUP BY lang, i) GROUP BY lang),
s AS (SELECT g.*, {_shares("cls")} pc, {_shares("h")} ph, {_shares("q_cls")} qc, {_shares("q_h")} qh
  FROM g JOIN refs ON refs.lang IS NOT DISTINCT FROM g.lang JOIN refh ON refh.lang IS NOT DISTINCT FROM g.lang),
j AS (SELECT *, {_distance("pc", "qc")} class_js, {_distance("ph", "qh")} common_js, len(w) < 50 OR 100 * n_repeat > 50 * len(w) base_failed FROM s)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(chars AS BIGINT) word_chars, CAST(sym AS BIGINT) n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines,
  CAST(n_repeat AS BIGINT) n_repeat_words, base_failed,
  NOT base_failed AND NOT (len(w) >= {MIN_WORDS} AND length(t) >= {MIN_CHARS} AND (class_js > {MAX_CLASS} OR common_js > {MAX_COMMON})) kept, class_js, common_js
FROM j
"""

ORACLES = {"op1_decontaminate": OP1, "op2_chat_format": OP2, "op4_jaccard_join": OP4, "op8_substring_dedup": OP8, "op9_quality_rules": OP9, "op10_pareto_mix": OP10}
