"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from siltstone.llm import preferences, quality

_SYMBOLS, _CAPITALS = "[#*$%&|<>]", "[A-Z]"
_WINDOW = quality.WINDOW


def _share(a: str, b: str) -> str:
    return f"{a} / greatest({b}, 1)"


_FEATURES = {
    "mean_word": _share("word_chars", "n_words"), "minus_mean_word": "-(" + _share("word_chars", "n_words") + ")", "symbol_share": _share("n_symbols", "word_chars"),
    "line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words"), "capital_share": _share("n_capitals", "word_chars"),
}
_LIST = lambda name: "[" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in quality.CUTOFFS[name]) + "]"
_BEYOND = ", ".join(f"len(list_filter({_LIST(name)}, lambda c: {_FEATURES[f]} > c))" for name, (f, _, _) in quality.RULES.items())
_FAILED = ", ".join(f"CASE WHEN {_FEATURES[f]} > {_LIST(name)}[place + 1] THEN '{name}' END" for name, (f, _, _) in quality.RULES.items())
_RATE = f"CAST({quality.ALPHA!r} AS DOUBLE)"
_BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
split_ AS (SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
windows AS (SELECT rid, i, array_to_string(ws[i:i + {_WINDOW - 1}], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - {_WINDOW - 2})) AS i FROM split_) a),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) a WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, {_WINDOW}) AS r(k) GROUP BY rid),
stats AS (SELECT s.rid, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '{_SYMBOLS}')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '{_CAPITALS}')) AS n_capitals FROM split_ s LEFT JOIN covered c ON s.rid = c.rid),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, s.doc_id, max(greatest({_BEYOND})) AS passed, min(quality) AS quality FROM stats s JOIN marks m ON s.doc_id = m.doc_id WHERE NOT ({_BASE_FAILED}) GROUP BY stratum, s.doc_id),
tests AS (SELECT stratum, place, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality <> 1) AS n_bad, count(*) FILTER (quality = 1 AND {quality.STEPS} - passed <= place) AS k, count(*) FILTER (quality <> 1 AND {quality.STEPS} - passed <= place) AS b FROM held, range(0, {quality.STEPS}) g(place) GROUP BY stratum, place),
tails AS (SELECT *, CASE WHEN k > n_good * {_RATE} THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({_RATE}) + (n_good - j) * ln(1 - {_RATE}))))) END AS p FROM tests),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY b / greatest(n_bad, 1) - {quality.GOOD_WEIGHT} * k / greatest(n_good, 1) DESC, place) AS best FROM (SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY place) AS worst FROM tails) a WHERE worst * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held) d) <= {quality.DELTA}),
steps AS (SELECT stratum, place FROM ranked WHERE best = 1 AND b > 0),
failed AS (SELECT s.*, coalesce(array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), '+'), '') AS rules FROM stats s LEFT JOIN steps c ON s.stratum IS NOT DISTINCT FROM c.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_FAILED} AS base_failed, NOT ({_BASE_FAILED}) AND rules = '' AS kept, stratum, rules AS failed_rules FROM failed"""

_O, _M, _C = (x.replace("\n", "' || chr(10) || '") for x in (preferences.OPEN, preferences.MIDDLE, preferences.CLOSE))
_TEXT = f"'{_O}' || role || '{_M}' || body || '{_C}'"
_MASK = "list({{'start': CAST(at_ + length(role) + {h} AS INTEGER), 'end': CAST(at_ + size_ AS INTEGER)}} ORDER BY place) FILTER (role = '{r}' AND side = '{s}' AND place >= prefix_turns)"


def _mask(side: str) -> str:
    return f"coalesce(CAST(to_json({_MASK.format(h=len(preferences.OPEN + preferences.MIDDLE), r=preferences.LEARNED_ROLE, s=side)}) AS VARCHAR), '[]') AS {side}_mask"


PREFERENCES = f"""
WITH turns AS (SELECT conv_id, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM turns GROUP BY pair_id HAVING min(conv_id) < max(conv_id)),
sides AS (SELECT t.*, chosen_id, rejected_id, CASE WHEN conv_id = chosen_id THEN 'chosen' ELSE 'rejected' END AS side FROM turns t JOIN pairs p ON t.pair_id = p.pair_id),
first AS (SELECT pair_id, coalesce(min(place) FILTER (n < 2 OR k > 1), max(place) + 1) AS prefix_turns FROM (SELECT pair_id, place, count(*) AS n, count(DISTINCT (role, body)) AS k FROM sides GROUP BY pair_id, place) a GROUP BY pair_id),
sized AS (SELECT s.*, prefix_turns, length({_TEXT}) AS size_ FROM sides s JOIN first f ON s.pair_id = f.pair_id),
placed AS (SELECT *, coalesce(sum(CASE WHEN place >= prefix_turns THEN size_ ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM sized)
SELECT pair_id, any_value(chosen_id) AS chosen_id, any_value(rejected_id) AS rejected_id, CAST(any_value(prefix_turns) AS BIGINT) AS prefix_turns,
  coalesce(string_agg({_TEXT}, '' ORDER BY place) FILTER (side = 'chosen' AND place < prefix_turns), '') AS prompt, coalesce(string_agg({_TEXT}, '' ORDER BY place) FILTER (side = 'chosen' AND place >= prefix_turns), '') AS chosen,
  coalesce(string_agg({_TEXT}, '' ORDER BY place) FILTER (side = 'rejected' AND place >= prefix_turns), '') AS rejected, {_mask('chosen')}, {_mask('rejected')} FROM placed GROUP BY pair_id"""

SHINGLES = """
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 2) END)) AS i FROM docs) a) b),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""
