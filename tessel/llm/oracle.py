"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from tessel.llm import chat, decontaminate, licenses, lines

_LOW = f"translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN iw USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_KNOWN = ", ".join(f"('{norm}', '{name}')" for norm, name in licenses.known().items())
_RULES = ", ".join(f"CASE WHEN contains(s, '>{'>'.join(ids)}>') THEN '{name}' END" for name, _, ids in licenses.RULES)

OP2 = rf"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS parts
FROM documents),
e AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS no FROM p),
f AS (SELECT doc_id, no, id FROM e JOIN (VALUES {_KNOWN}) k(norm, id) ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = norm),
g AS (SELECT *, no - lag(no) OVER (PARTITION BY doc_id ORDER BY no) AS gap FROM f),
h AS (SELECT doc_id, '>' || string_agg(CASE WHEN gap <= {licenses.MAX_GAP + 1} THEN '' ELSE '|>' END || id || '>', '' ORDER BY no) AS s,
             string_agg(CAST(no AS VARCHAR) || ':' || id, ',' ORDER BY no) AS found FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_sentences, coalesce(found, '') AS found,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{_RULES}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM p LEFT JOIN h USING (doc_id)
"""

_COMPONENTS = """
r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, s.b FROM r JOIN both_ways s ON r.b = s.a),
comp AS (SELECT a, min(b) AS low FROM r GROUP BY a)"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_COMPONENTS}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON vec_id = comp.a LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) c ON vec_id = c.a
"""

OP5 = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, len(string_split(key, ' ')) AS words FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS key FROM l)),
bp AS (SELECT key, min(doc_id * 1000000 + no) AS first, count(DISTINCT source) >= {lines.MIN_SITES} AS wide FROM k WHERE key <> '' GROUP BY key, words
  HAVING count(DISTINCT source) >= CASE WHEN words > {lines.LONG_WORDS} THEN {lines.LONG_SITES} ELSE {lines.MIN_SITES} END),
o AS (SELECT k.*, coalesce(wide, false) AND doc_id * 1000000 + no <> first AS boiler, NOT coalesce(wide, true) AND doc_id * 1000000 + no <> first AS passage FROM k LEFT JOIN bp USING (key)),
q AS (SELECT doc_id, 2 * coalesce(sum(words) FILTER (WHERE passage), 0) <= coalesce(sum(words) FILTER (WHERE key <> ''), 0) AS quotes FROM o GROUP BY doc_id),
m AS (SELECT o.*, boiler OR (passage AND quotes) AS gone FROM o JOIN q USING (doc_id)),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS n_chars_left, sha256(kept) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP9 = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length({_escaped('role')}) + length({_escaped('text')}) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = '{chat.TRAINED_ROLE}'), '') AS loss, sum(n + {len(chat.TURN) + len(chat.END) + 2}) AS size FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
both_ways AS (SELECT a, b FROM c JOIN n u ON a = u.doc_id JOIN n v ON b = v.doc_id WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
{_COMPONENTS}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON doc_id = comp.a
"""

ORACLES = {"op1_decontaminate": OP1, "op2_licenses": OP2, "op3_embedding_pairs": OP3, "op5_line_dedup": OP5, "op9_chat": OP9, "op10_near_duplicates": OP10}
