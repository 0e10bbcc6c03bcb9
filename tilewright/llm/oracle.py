"""DuckDB SQL for those of the queries that SQL can express.

Learnt scores (1, 5, 10), stored media (4), tokenizers (6, 9, 13) and nested expressions (12) cannot be; tests/llm holds them against plain versions."""

from __future__ import annotations

from tilewright.llm import mixing
from tilewright.llm.substrings import WINDOW

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _case(values: tuple) -> str:
    return "CASE nth % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS.format(text="text")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth FROM d GROUP BY source),
r AS (SELECT source, nth, source_size::DOUBLE AS source_size, ({_case(mixing.WEIGHTS)})::DOUBLE AS w, false AS capped, 0 AS k FROM s
  UNION ALL SELECT source, nth, source_size, w, capped OR rest * w / free > {mixing.CAP} * source_size, k + 1
  FROM (SELECT *, {mixing.SHARE} * sum(source_size) OVER () - coalesce(sum({mixing.CAP} * source_size) FILTER (capped) OVER (), 0) AS rest, sum(w) FILTER (NOT capped) OVER () AS free FROM r WHERE k < 64)),
t AS (SELECT source, source_size::BIGINT AS source_size, ({_case(mixing.TILTS)})::DOUBLE AS tilt, round(CASE WHEN capped THEN {mixing.CAP} * source_size ELSE ({mixing.SHARE} * sum(source_size) OVER () - coalesce(sum({mixing.CAP} * source_size) FILTER (capped) OVER (), 0)) * w / sum(w) FILTER (NOT capped) OVER () END, 6)::DOUBLE AS target
  FROM r WHERE k = 64),
p AS (SELECT d.*, t.source_size, t.target, t.tilt, round(t.target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
l AS (SELECT *, greatest(0, least(size, goal - whole * source_size - done)) AS last FROM q),
m AS (SELECT *, whole * size + last AS taken, CASE WHEN goal > 0 THEN least(1.0::DOUBLE, CASE WHEN size = 0 THEN done ELSE done + (CASE WHEN whole > 0 THEN size ELSE last END) / 2.0::DOUBLE END / goal::DOUBLE) ELSE 0.5::DOUBLE END AS part FROM l)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 AND taken = 0 THEN NULL ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
  CASE WHEN tilt = 0 THEN part ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * part) - (1 - tilt)) / (2 * tilt) END)), 9) END AS position FROM m"""

#: Shingles are compared as texts: words joined by spaces, of which a word has none.
NEARDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM w WHERE len(w) >= 5),
y AS (SELECT doc_id, i, n, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER p" for k in range(1, 5))}) AS v FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT DISTINCT doc_id, v FROM y WHERE i <= n - 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
s AS (SELECT w.doc_id, count(v) AS size FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id),
often AS (SELECT v, row_number() OVER () AS name FROM f GROUP BY v HAVING count(*) > 1), g AS MATERIALIZED (SELECT doc_id, size, name FROM f JOIN often USING (v) JOIN s USING (doc_id)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.size AS m, b.size AS n, count(*) AS shared FROM g a JOIN g b ON a.name = b.name AND a.doc_id < b.doc_id AND 4 * a.size >= 3 * b.size AND 4 * b.size >= 3 * a.size GROUP BY ALL),
linked AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (m + n - shared)),
ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT doc_id AS n, doc_id AS m FROM s UNION SELECT r.n, e.b FROM reach r JOIN ways e ON e.a = r.m),
c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n)
SELECT doc_id, size AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON n = doc_id"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM w),
named AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS passage FROM words),
whole AS MATERIALIZED (SELECT doc_id, pos, md5(passage) AS passage FROM named WHERE pos <= n - {WINDOW}),
twice AS (SELECT passage FROM whole GROUP BY passage HAVING count(*) > 1), gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM whole JOIN twice USING (passage), range({WINDOW}) r(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN e], true) AND list_dot_product(e, e) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN linked l ON l.a = r.m), c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM linked GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id"""

#: Every group gets every kept term; groups without kept terms come back for the pairs.
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d), n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS rows FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM n GROUP BY ALL HAVING sum(rows) >= 30), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n, total::HUGEINT AS total FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (sum(n) OVER own + 5 * count(*) OVER own))::BIGINT AS p, (1 + (1000000000 * (total + 5)) // (sum(total) OVER own + 5 * count(*) OVER own))::BIGINT AS q FROM c WINDOW own AS (PARTITION BY lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""

SQL = {"op11_divergence": DIVERGENCE, "op2_mixing": MIXING, "op3_neardup": NEARDUP, "op7_substrings": SUBSTRINGS, "op8_embedding_dedup": EMBEDDINGS}
