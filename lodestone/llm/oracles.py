"""SQL for those queries of :mod:`.queries` that SQL can express (DuckDB, tables as views)."""

from __future__ import annotations

from .licenses import BLOCK_END, TEMPLATES, TERM, TRIGGERS

OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BODIES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(body)})" for k, (name, body) in enumerate(TEMPLATES))

OP2 = f"""
WITH template(k, license, body) AS (VALUES {_BODIES}),
tt AS (SELECT k, license, term, count(*) AS tf FROM (SELECT k, license, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM template) GROUP BY ALL),
files AS (SELECT doc_id, coalesce(text, '') AS text,
  coalesce(source, 'none') || CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 10 = 0 THEN '/' || coalesce(lang, 'none')
    ELSE '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) END AS directory FROM documents),
held AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files)),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM (SELECT term FROM tt UNION SELECT term FROM held)
  LEFT JOIN (SELECT term, count(*) AS df FROM held GROUP BY 1) USING (term), n),
tw AS (SELECT k, license, term, tf * idf AS t FROM tt JOIN idf USING (term)),
tn AS (SELECT k, sqrt(sum(t * t)) AS t_norm FROM tw GROUP BY 1),
piece AS (SELECT DISTINCT doc_id, piece FROM (
  SELECT doc_id, unnest(string_split(text, chr(10)) || regexp_split_to_array(text, '{BLOCK_END}')) AS piece FROM files UNION ALL SELECT doc_id, text FROM files)
  WHERE regexp_matches(piece, '{TRIGGERS}')),
pt AS (SELECT piece, term, count(*) AS tf FROM (SELECT piece, unnest(regexp_extract_all(lower(piece), '{TERM}')) AS term FROM (SELECT DISTINCT piece FROM piece)) GROUP BY ALL),
pw AS (SELECT piece, term, tf * idf AS p FROM pt JOIN idf USING (term)),
pn AS (SELECT piece, sqrt(sum(p * p)) AS p_norm FROM pw GROUP BY 1),
cosine AS (SELECT piece, license, k, round(sum(p * t) / any_value(t_norm) / any_value(p_norm), 6) AS cosine
  FROM pw JOIN tw USING (term) JOIN tn USING (k) JOIN pn USING (piece) GROUP BY piece, license, k),
own AS (SELECT doc_id, min(struct_pack(o := -cosine, l := license)) AS b FROM piece JOIN cosine USING (piece) WHERE cosine >= 0.6 GROUP BY 1),
row_ AS (SELECT doc_id, directory, directory || '/' || doc_id || '.txt' AS path, b.l AS own_license, -b.o AS cosine FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT directory AS name, min(struct_pack(o := -n, l := own_license)).l AS given
  FROM (SELECT directory, own_license, count(*) AS n FROM row_ WHERE own_license IS NOT NULL GROUP BY ALL) GROUP BY 1),
near AS (SELECT directory, max(struct_pack(d := length(name), name := name, given := given)) AS near
  FROM (SELECT DISTINCT directory FROM row_) JOIN given ON name = directory OR starts_with(directory, name || '/') GROUP BY 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, near.given) AS license,
       CASE WHEN own_license IS NULL THEN near.name END AS inherited_from
FROM row_ LEFT JOIN near USING (directory)
"""


def _shared(name: str, parent: str, above: str, level: str) -> str:
    """A level's budgets: children by capacity per weight, filled as long as they fit their share."""
    keys = f"{above}{level}"
    join = f"JOIN {parent} USING ({above.rstrip(', ')})" if above else f", {parent}"
    part = f"PARTITION BY {above.rstrip(', ')} " if above else ""
    return f"""
{name}_kids AS (SELECT {keys}, budget AS given, tokens, sqrt(tokens) AS w, row_number() OVER ({part}ORDER BY tokens / sqrt(tokens), {level}) AS r
  FROM (SELECT {keys}, sum(tokens)::BIGINT AS tokens FROM leaf GROUP BY ALL) {join}),
{name}_per AS (SELECT *, (given - coalesce(sum(tokens) OVER ({part}ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({part}ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per FROM {name}_kids),
{name}_rest AS (SELECT *, tokens <= per * w * (1 + 1e-12) AS filled FROM {name}_per),
{name}_first AS (SELECT *, arg_min(per, r) FILTER (NOT filled) OVER ({part}) AS level_ FROM {name}_rest),
{name} AS (SELECT {keys}, least(CASE WHEN filled THEN tokens::DOUBLE ELSE level_ * w END, tokens::DOUBLE) AS budget FROM {name}_first)"""


OP4 = rf"""
WITH base AS (SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  len({_WORDS.format(t="coalesce(text, '')")}) AS n_tokens FROM documents),
doc AS (SELECT doc_id, CASE WHEN number = '' THEN 'none' ELSE 'domain' || (number::INT % 4) END AS domain, lang, source, n_tokens FROM base),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM doc GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT least(floor(sum(tokens) * 0.8::DOUBLE), sum(tokens))::DOUBLE AS budget FROM leaf),
{_shared("a", "root", "", "domain")},
{_shared("b", "a", "domain, ", "lang")},
{_shared("c", "b", "domain, lang, ", "source")},
known AS (SELECT doc.*, coalesce(tokens, 0) AS leaf_tokens, coalesce(floor(round(budget, 3))::BIGINT, 0) AS leaf_budget
  FROM doc LEFT JOIN leaf USING (domain, lang, source) LEFT JOIN c USING (domain, lang, source)),
turned AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN leaf_budget // leaf_tokens ELSE 0 END AS full_epochs FROM known),
placed AS (SELECT *, leaf_budget - full_epochs * leaf_tokens AS rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('4:' || full_epochs || ':' || doc_id), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turned),
used AS (SELECT *, greatest(0, least(n_tokens, rest - before)) AS partial_tokens FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, full_epochs, partial_tokens::BIGINT AS partial_tokens,
       full_epochs > 0 AND n_tokens > 0 OR partial_tokens > 0 AS kept
FROM used
"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(x) AS x, x AS t FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
-- A pair above 85 % shares a shingle of the first 15 % of each in any common order, here that of (frequency, hash).
f AS (SELECT x, count(*) AS f FROM s GROUP BY 1),
o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r FROM s JOIN f USING (x)),
p AS (SELECT doc_id, x FROM o JOIN n USING (doc_id) WHERE r <= n - ceil(0.85 * n) + 1),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)),
common AS (SELECT a, b, count(*) AS i FROM pair JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.t = x.t GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
e AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN hash(w[i : i + 34]) END AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
r AS (SELECT h FROM e WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT doc_id, i, word, max(r.h IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM e LEFT JOIN r ON e.h = r.h),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op1_exact_dedup": OP1,
    "op2_license_scan": OP2,
    "op4_mix_sources": OP4,
    "op6_minhash_near_dedup": OP6,
    "op7_substring_dedup": OP7,
}
