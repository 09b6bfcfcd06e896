"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from eventloom.llm.license_scan import SMALL, TEMPLATES, UPPER, Template

WHITE = "[\\x20\\x09-\\x0D]"


def words(text: str, apart: str) -> str:
    return f"list_filter(string_split_regex({text}, '{apart}+'), lambda x: x <> '')"


FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{SMALL}')"
REACH = "reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT reach.x, e.b FROM reach JOIN both_ways e ON e.a = reach.y), least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(FOLDED, WHITE)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM s LEFT JOIN least_of ON x = doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {REACH}, k AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept FROM v LEFT JOIN least_of ON x = vec_id LEFT JOIN k ON k.a = vec_id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')", WHITE)} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(greatest(len(w) - 34, 0))) AS i, unnest(list_transform(range(greatest(len(w) - 34, 0)), lambda i: md5(array_to_string(w[i + 1:i + 35], ' ')))) AS h FROM w),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN again USING (h)),
word AS (SELECT doc_id, unnest(range(len(w))) AS k, unnest(w) AS word FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.k) AS text FROM word LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY word.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

EXACT = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


def _places(t: Template) -> str:
    phrase = ", ".join(f"'{w}'" for w in t.phrase)
    return f"list_filter(range(len(w)), lambda s: w[s + 1:s + {t.length}] = [{phrase}])"


def _share(t: Template, name: str) -> str:
    hits = " + ".join(f"(CASE WHEN s + {k - t.key} >= 0 AND w[s + {k - t.key + 1}] = '{word}' THEN 1 ELSE 0 END)" for k, word in enumerate(t.words))
    return f"coalesce(list_max(list_transform({name}, lambda s: ({hits}) / {float(len(t.words))}::DOUBLE)), 0)"


def licences(templates: tuple[Template, ...]) -> str:
    names = {t.label: f"p{k}" for k, t in enumerate(templates)}
    base = [t for t in templates if t.base]
    every = " || ".join(names[t.label] for t in base)
    listed = lambda ts: "concat_ws(',', " + ", ".join(f"CASE WHEN len({names[t.label]}) > 0 THEN '{t.label}' END" for t in sorted(ts, key=lambda t: t.label)) + ")"
    return f"""
WITH w AS (SELECT doc_id, {words(FOLDED, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]")} AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(f"{_places(t)} AS {names[t.label]}" for t in templates)} FROM w)
SELECT doc_id, len(w)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
{listed(base)} AS base_labels, {listed(templates)} AS labels, greatest({", ".join(_share(t, names[t.label]) for t in templates)})::DOUBLE AS score FROM p
"""


AUDIT = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {words("coalesce(text, '')", WHITE)} AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
  len(w) < 200,
  100 * len(list_distinct(w)) < 50 * len(w),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
  regexp_matches(text, '[#$%&*|]'),
  coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false)] AS fails FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT unnest([1, 2, 3, 4, 5]) AS c),
o AS (SELECT [a.c, b.c, d.c, e.c, g.c] AS o FROM c a JOIN c b ON b.c <> a.c JOIN c d ON d.c NOT IN (a.c, b.c) JOIN c e ON e.c NOT IN (a.c, b.c, d.c) JOIN c g ON g.c NOT IN (a.c, b.c, d.c, e.c)),
x AS (SELECT part, good, toxic, fails, o, coalesce(list_position(list_transform(o, lambda k: fails[k]), true), 6) AS first FROM f CROSS JOIN o),
s AS (SELECT *, o[step] AS k FROM x CROSS JOIN (SELECT c AS step FROM c)),
n AS (SELECT part, list_aggregate(list_transform(o, lambda k: substring('ABCDE', k, 1)), 'string_agg', '') AS filter_order, step, k,
  count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (fails[k] AND first < step) AS redundant,
  count(*) FILTER (fails[k] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, o, step, k)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM n
"""

TRIE = """
WITH m AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS own FROM m GROUP BY conv_id),
bits AS (SELECT conv_id, list(ascii(substring(conv_id::VARCHAR, k::INTEGER, 1)) ORDER BY k) AS codes FROM (SELECT conv_id, unnest(range(1, length(conv_id::VARCHAR) + 1)) AS k FROM own) GROUP BY conv_id),
crc AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM (SELECT conv_id, list_transform(codes, lambda c: c::BIGINT) AS codes FROM bits)),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(d.own, [])[:crc % 9], a.own[crc % 9 + 1:]) AS turns FROM own a JOIN crc USING (conv_id) LEFT JOIN own d ON d.conv_id = a.conv_id - a.conv_id % 5),
prefix AS (SELECT conv_id, d, turns[:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended,
  (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].text)) END) AS own_saved FROM prefix GROUP BY path, d),
up AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN up USING (path)),
spread AS (SELECT path[:k] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM told) GROUP BY 1)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(t.ended) AS ends_sha256
FROM told t JOIN spread ON spread.path = t.path LEFT JOIN node p ON p.path = t.path[:t.d - 1] AND t.d > 0
"""

ORACLES = {"op11_filter_audit": AUDIT, "op12_prefix_trie": TRIE, "op1_ngram_jaccard_join": JACCARD, "op4_license_scan": licences(TEMPLATES), "op5_embedding_dedup": EMBEDDINGS, "op9_substring_dedup": REPEATS, "op10_exact_dedup": EXACT}
