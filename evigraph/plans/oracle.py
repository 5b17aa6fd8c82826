"""SQL fragments for DuckDB that say the same as the column functions."""

from __future__ import annotations

from evigraph.functions import text as T


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def strings(xs: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def bordered(x: str) -> str:
    """RE2 takes letters beyond ASCII for word borders: they become "_", which is none."""
    return rf"regexp_replace({x}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]|\p{{M}}', '_', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), {q(T.TOKEN)}), lambda t: length(t) >= 2 AND NOT list_contains({strings(T.STOPWORDS)}, t))"


def sentences(x: str) -> str:
    """RE2 has no lookbehind: the gap is marked first, then split."""
    marked = rf"""regexp_replace({strip(f"coalesce({x}, '')")}, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def slug(x: str, most: int) -> str:
    return rf"coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {most}), '-+$', ''), ''), 'x')"


def truncated(x: str, n: int) -> str:
    whole = strip(f"coalesce({x}, '')")
    return rf"CASE WHEN length({whole}) <= {n} THEN {whole} ELSE regexp_replace(substr({whole}, 1, {n - 1}), '\s+$', '') || '…' END"


def features(t: str) -> str:
    return f"list_concat({t}, list_transform(list_zip({t}[:-2], {t}[2:]), lambda p: p[1] || '_' || p[2]))"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def entities(x: str) -> str:
    phrases = f"list_filter(list_transform(regexp_extract_all({bordered(x)}, {q(T.PHRASE)}, 1), lambda p: {strip('p')}), lambda p: NOT list_contains({strings(T.ENTITY_STOP)}, string_split(p, ' ')[1]))"
    acronyms = f"list_filter(regexp_extract_all({bordered(x)}, {q(T.ACRONYM)}), lambda a: NOT list_contains({strings(T.ACRONYM_STOP)}, a))"
    labels = f"list_filter(list_transform(regexp_extract_all({x}, {q(T.LINK)}, 1), lambda l: {strip('l')}), lambda l: regexp_matches(l, '^[A-Z]'))"
    return distinct_in_order(f"list_concat(list_concat({phrases}, {acronyms}), {labels})") + "[1:8]"


def refs(x: str) -> str:
    names = f"list_filter(list_transform(regexp_extract_all({x}, {q(T.SEE)}, 1), lambda r: regexp_replace(r, '^[ .,;:]+|[ .,;:]+$', '', 'g')), lambda r: r <> '' AND NOT list_contains({strings(T.REF_STOP)}, lower(r)))"
    anchors = f"list_filter(list_transform(list_filter(regexp_extract_all({x}, {q(T.LINK)}, 2), lambda t: starts_with(t, '#')), lambda t: replace(substr(t, 2), '-', ' ')), lambda t: t <> '')"
    return distinct_in_order(f"list_concat({names}, {anchors})") + "[1:6]"


def questions(rows: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in rows) + ") v(query_id, query)"


NUMBERED = r"^(?:(?:chapter|section|part|appendix)\s+[\dIVXivx]+\b.*|\d+(?:\.\d+)*\.?\s+\S.*)$"
_TEXT_BLOCKS = rf"""
l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, {strip('unnest(x)')} AS line FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS x FROM documents)),
h AS (SELECT *, regexp_matches(line, {q(NUMBERED)}) AND length(line) <= 80 AS numbered,
  length(line) <= 80 AND ((line = upper(line) AND line <> lower(line)) OR regexp_matches(line, {q(NUMBERED)})) AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head OR line = '' THEN 1 ELSE 0 END) OVER w AS island,
  max(CASE WHEN head AND NOT numbered THEN pos END) OVER w AS p1, max(CASE WHEN head AND numbered THEN pos END) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT doc_id, island, any_value(p1) AS p1, any_value(p2) AS p2, string_agg(line, ' ' ORDER BY pos) AS text FROM g WHERE line <> '' AND NOT head GROUP BY doc_id, island),
blocks AS (SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY island) - 1)::INT AS block,
  array_to_string(list_filter([coalesce(regexp_replace(a.line, '\.+$', ''), ''), CASE WHEN p2 > coalesce(p1, 0) THEN regexp_replace(c.line, '\.+$', '') ELSE '' END], lambda t: t <> ''), ' › ') AS path, b.text
  FROM b LEFT JOIN h a ON a.doc_id = b.doc_id AND a.pos = p1 LEFT JOIN h c ON c.doc_id = b.doc_id AND c.pos = p2)
"""
TEXT_BLOCKS = f"WITH {_TEXT_BLOCKS} SELECT doc_id, block, path, text FROM blocks"
FLATTENED = f"WITH {_TEXT_BLOCKS} SELECT doc_id, string_agg(text, chr(10) ORDER BY block) AS flat, count(*) AS blocks FROM blocks GROUP BY doc_id"

WINDOWS = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {sentences('text')} AS s FROM documents),
f AS (
  SELECT doc_id, 0 AS i, []::VARCHAR[] AS cur, 0::BIGINT AS size, []::VARCHAR[] AS done FROM d WHERE len(s) > 0
  UNION ALL
  SELECT f.doc_id, i + 1,
    CASE WHEN len(cur) > 0 AND size + length(d.s[i + 1]) > 300 THEN [cur[-1], d.s[i + 1]] ELSE list_append(cur, d.s[i + 1]) END,
    CASE WHEN len(cur) > 0 AND size + length(d.s[i + 1]) > 300 THEN length(cur[-1]) + length(d.s[i + 1]) + 2 ELSE size + length(d.s[i + 1]) END,
    CASE WHEN len(cur) > 0 AND size + length(d.s[i + 1]) > 300 THEN list_append(done, array_to_string(cur, ' ')) ELSE done END
  FROM f JOIN d ON d.doc_id = f.doc_id WHERE i < len(d.s)
),
e AS (SELECT f.doc_id, list_append(done, array_to_string(cur, ' ')) AS w FROM f JOIN d ON d.doc_id = f.doc_id WHERE i = len(d.s)
  UNION ALL SELECT doc_id, [substr(t, 1, 300)] FROM d WHERE len(s) = 0 AND t <> '')
SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS w, unnest(w) AS text FROM e
"""

EMBEDDED = f"""
WITH t AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
f AS (SELECT doc_id, feature, count(*) AS tf FROM (SELECT doc_id, unnest({features('t')}) AS feature FROM t) GROUP BY ALL),
b AS (SELECT doc_id, (('0x' || substr(md5(feature), 1, 8))::BIGINT % 512)::INT AS bucket, sum((1 + ln(tf)) * CASE WHEN contains(feature, '_') THEN 1.5 ELSE 1.0 END) AS w FROM f GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(w / norm, 6) AS weight FROM b JOIN n USING (doc_id)
"""

CHUNKS = """
c AS (SELECT id, doc_id, coalesce(doc_title, '') AS doc_title, list_filter(coalesce(section_path, []), lambda x: x IS NOT NULL) AS path, coalesce(section_title, '') AS section_title,
  coalesce(text, '') AS text, kind, token_estimate, list_filter(coalesce(entities, []), lambda x: x IS NOT NULL) AS entities, list_filter(coalesce(refs, []), lambda x: x IS NOT NULL) AS refs, coalesce(chunk_order, 0) AS o
  FROM (SELECT DISTINCT ON (id) * FROM chunks) WHERE id IS NOT NULL AND doc_id IS NOT NULL)
"""


def section(path: str, depth: str) -> str:
    return f"'sec:' || doc_id || ':' || {depth} || ':' || " + slug(f"array_to_string({path}[1:{depth}], ' ')", 50)


CHAIN = f"""
deep AS (SELECT doc_id, id, o, path, unnest(generate_series(1, len(path))) AS depth FROM c WHERE len(path) > 0),
chain AS (SELECT doc_id, id, o, depth, path[1:depth] AS path, {section('path', 'depth')} AS node, CASE WHEN depth = 1 THEN 'doc:' || doc_id ELSE {section('path', '(depth - 1)')} END AS parent FROM deep)
"""

NODES = f"""
every AS (
  SELECT 'doc:' || doc_id AS id, 'doc' AS type, arg_min(doc_title, o) AS label, doc_id, NULL AS section, doc_id AS d, 0 AS o, 0 AS p FROM c GROUP BY doc_id
  UNION ALL SELECT node, 'section', path[-1], doc_id, array_to_string(path, ' › '), doc_id, o, depth FROM chain
  UNION ALL SELECT id, 'chunk', {truncated('text', 56)}, doc_id, array_to_string(path, ' › '), doc_id, o, 0 FROM c
  UNION ALL SELECT 'ent:' || {slug('label', 50)}, 'entity', label, NULL, NULL, doc_id, o, p FROM (SELECT doc_id, o, generate_subscripts(entities, 1) AS p, unnest(entities) AS label FROM c)),
nodes AS (SELECT id, type, label, doc_id, section FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC, o DESC, p DESC) = 1)
"""

REFERENCES = f"""
refs AS (SELECT DISTINCT doc_id, id, lower({strip('r')}) AS key FROM (SELECT doc_id, id, unnest(refs) AS r FROM c) WHERE lower({strip('r')}) <> ''),
titled AS (SELECT doc_id, lower({strip('section_title')}) AS title, id AS target, o FROM c WHERE lower({strip('section_title')}) <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY o, target) AS n FROM titled QUALIFY n <= 2),
titles AS (SELECT doc_id, title, min(o) AS o FROM firsts GROUP BY ALL),
doct AS (SELECT doc_id, lower({strip('arg_min(doc_title, o)')}) AS title FROM c GROUP BY doc_id),
hit AS (
  SELECT r.doc_id, r.id, r.key, t.title, 1 AS prio, t.o FROM refs r JOIN titles t ON r.doc_id = t.doc_id AND r.key = t.title
  UNION ALL SELECT r.doc_id, r.id, r.key, t.title, 2, t.o FROM refs r JOIN titles t ON r.doc_id = t.doc_id AND contains(t.title, r.key)
  UNION ALL SELECT r.doc_id, r.id, r.key, t.title, 3, 0 FROM refs r JOIN doct t ON r.doc_id = t.doc_id AND contains(t.title, r.key)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, id, key ORDER BY prio, o, title) = 1),
referenced AS (SELECT DISTINCT b.id AS u, f.target AS v FROM best b JOIN firsts f ON b.prio < 3 AND b.doc_id = f.doc_id AND b.title = f.title WHERE b.id <> f.target
  UNION SELECT id, 'doc:' || doc_id FROM best WHERE prio = 3)
"""

VECTORS = """
v AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

EDGES = f"""
rel0 AS (SELECT a.id AS k, b.id AS w, list_dot_product(a.e, b.e) AS s FROM (SELECT v.*, doc_id FROM v JOIN c USING (id)) a JOIN (SELECT v.*, doc_id FROM v JOIN c USING (id)) b ON a.doc_id = b.doc_id AND a.id <> b.id),
rel AS (SELECT * FROM rel0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, w) <= 2),
raw AS (
  SELECT parent AS u, node AS v, 'CONTAINS' AS kind, 1.0::DOUBLE AS weight, 0 AS seq FROM chain
  UNION ALL SELECT CASE WHEN len(path) = 0 THEN 'doc:' || doc_id ELSE {section('path', 'len(path)')} END, id, 'CONTAINS', 1.0, 0 FROM c
  UNION ALL SELECT id, 'ent:' || {slug('e', 50)}, 'MENTIONS', 1.0, 1 FROM (SELECT id, unnest(entities) AS e FROM c)
  UNION ALL SELECT least(k, w), greatest(k, w), 'RELATES_TO', s, 2 FROM rel WHERE s >= 0.32
  UNION ALL SELECT u, v, 'REFERENCES', 0.6, 3 FROM referenced),
edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(kind, seq) AS kind, max(weight) AS weight FROM raw WHERE u <> v GROUP BY 1, 2),
ends AS (SELECT u, v, kind, weight FROM edges UNION ALL SELECT v, u, kind, weight FROM edges)
"""

GRAPH = ",".join(x.strip() for x in (CHUNKS, CHAIN, NODES, REFERENCES, VECTORS, EDGES))

#: The log of searches as candidates: query_id is a chunk's id, its document's title stands for the question.
HITS = f"""
h AS (SELECT query_id, id, min(hit_no) AS rank, coalesce(max(CASE WHEN isfinite(score) THEN score END), 0.0) AS sim FROM search_hits WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
qs AS (SELECT id AS query_id, doc_title AS query, list_distinct({tokens('doc_title')}) AS qt FROM c),
k AS (SELECT h.*, qs.query, qs.qt, c.text, c.doc_title, c.path, c.entities, c.token_estimate, c.o, c.kind,
  CASE WHEN len(qt) = 0 THEN 0.0 ELSE least(1.0, len(list_intersect(qt, list_distinct({tokens('c.text')}))) / (sqrt(len(qt)) + 1)) END AS lexical,
  CASE WHEN len(qt) = 0 OR len(c.entities) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(c.entities, lambda e: len(list_intersect({tokens('e')}, qt)) > 0)) / sqrt(len(c.entities))) END AS entity
  FROM h JOIN qs USING (query_id) JOIN c ON c.id = h.id)
"""
CANDIDATES = ",".join(x.strip() for x in (CHUNKS, HITS))

GATE = f"""
WITH RECURSIVE {CANDIDATES},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank) AS n FROM k),
f AS (
  SELECT query_id, 0::BIGINT AS n, 0.0::DOUBLE AS lat, 0 AS fired, '' AS id, 0.0::DOUBLE AS potential, false AS hit, '' AS reason FROM (SELECT DISTINCT query_id FROM r)
  UNION ALL
  SELECT query_id, n, CASE WHEN hit THEN greatest(lat, sim) ELSE lat END, fired + hit::INT, id, CASE WHEN full_ THEN 0.0 ELSE v END, hit,
    CASE WHEN full_ THEN 'suppressed: context capacity reached' WHEN hit THEN '' WHEN lat > 0 THEN 'suppressed: lateral inhibition (redundant context)' ELSE 'suppressed: sub-threshold potential' END
  FROM (SELECT *, NOT full_ AND v >= 0.3 AS hit FROM (
    SELECT f.query_id, r.n, f.lat, f.fired, r.id, r.sim, f.fired >= 6 AS full_, 0.55 * greatest(0.0, r.sim) + 0.25 * greatest(0.0, r.lexical) + 0.2 * greatest(0.0, r.entity) - 0.35 * greatest(0.0, f.lat) - 0.3 * 0.0 AS v
    FROM f JOIN r ON r.query_id = f.query_id AND r.n = f.n + 1)))
SELECT query_id, id, n::INT AS n, round(potential, 4) AS potential, hit AS fired, reason FROM f WHERE n > 0
"""
