"""The catalog's queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import re

from ..functions.aliases import OWNERS, SERVICES
from ..functions.text import SIMPLE
from ..operators.extract import ENTITIES, PHRASE, RELATIONS
from ..operators.graph_query import CLOSED
from .fixtures import sql_values
from .given import ASSIGNEES, MAILS, NAMES, WRITERS

FILES = r"""
files AS (SELECT doc_id || '.txt' AS filename, coalesce(text, '') AS text FROM documents),
split AS (SELECT filename, substr(sha256(filename || substr(text, 1, 200)), 1, 12) AS doc_id, regexp_extract_all(text, '\S+') AS tok FROM files),
counted AS (SELECT *, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) < 20 THEN 1 ELSE (len(tok) - 20) // 350 + 1 END AS k FROM split),
windows AS (SELECT *, unnest(range(k)) AS i FROM counted),
chunks AS (SELECT doc_id || '_chunk_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS chunk_id, doc_id, filename,
           array_to_string(tok[i * 350 + 1 : i * 350 + 400], ' ') AS text, i::INTEGER AS chunk_index, k::INTEGER AS total_chunks FROM windows)
"""
BM25 = r"""
terms AS (SELECT chunk_id, regexp_extract_all(lower(text), '\S+') AS t FROM chunks),
postings AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM terms) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
mean AS MATERIALIZED (SELECT avg(raw) AS avg_raw FROM raws),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_raw ELSE raw END AS idf FROM raws, mean),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
         FROM asked JOIN stats USING (term) JOIN postings USING (term), corpus GROUP BY ALL),
everything AS (SELECT b.item_id AS query_id, c.chunk_id, coalesce(h.score, 0) AS score FROM benchmark b CROSS JOIN chunks c LEFT JOIN hits h ON h.query_id = b.item_id AND h.chunk_id = c.chunk_id),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM everything) WHERE rank <= 50)
"""


def _parts(rows: str, key: str, text: str) -> str:
    return rf"""
  SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (
    SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS n
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\S+')) AS term FROM {rows}) GROUP BY ALL)"""


VECTOR = f"""
parts AS ({_parts("chunks", "chunk_id", "text")}),
asked_parts AS ({_parts("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text")}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
           SELECT query_id, chunk_id, sum(p.w * q.w) AS score FROM parts p JOIN asked_parts q USING (bucket) GROUP BY ALL)) WHERE rank <= 50)
"""
FUSED = """
both_ AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, l.score AS bm25_score, v.score AS vector_score, l.rank AS ra, v.rank AS rb,
          coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf
          FROM lexical l FULL JOIN near v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM both_) WHERE rank <= 20)
"""
RERANKED = r"""
scored AS (SELECT f.query_id, f.chunk_id, f.rank,
           len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '\S+')), list_distinct(regexp_extract_all(lower(c.text), '\S+')))) / len(list_distinct(regexp_extract_all(lower(b.text), '\S+'))) AS score
           FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN chunks c USING (chunk_id)),
reranked AS (SELECT query_id, chunk_id, r AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM scored) WHERE r <= 5)
"""
COSINE = """
q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS score FROM embeddings, q)
"""
_COSINE = "list_inner_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[]) / (sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[])) * sqrt(list_inner_product({1}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])) + 1e-9)"
PAIRS = f"pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, {_COSINE.format('x', 'y')} AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
#: Of equal vectors the first stands for all; the others are paired with it alone.
FIRST_PAIRS = f"{PAIRS}, firsts AS (SELECT embedding, min(vec_id) AS first FROM embeddings GROUP BY embedding), named AS (SELECT vec_id, first FROM embeddings JOIN firsts USING (embedding)), kept AS (SELECT p.* FROM pairs p JOIN named x ON x.vec_id = a JOIN named y ON y.vec_id = b WHERE a = x.first AND (b = y.first OR y.first = a))"


def _re2(pattern: str) -> str:
    """A pattern of ours as RE2 has it: of its flags only that letters' case doesn't count. RE2 has no look-ahead."""
    flags = re.match(r"^\(\?(\w+)\)", pattern)
    plain = pattern[flags.end() :] if flags else pattern
    return ("(?i)" if flags and "i" in flags[1] else "") + re.sub(r"\(\?!.*?\)", "", plain)


def _found(kind: str, pattern: str) -> str:
    """All of a text's matches. What a pattern's look-ahead rules out is a ticket, so it is left out afterwards."""
    named = f"lambda v: {{'type': '{kind}', 'name': v}}"
    if "(?!" not in pattern:
        return f"list_transform(regexp_extract_all(t, '{_re2(pattern)}', 1), {named})"
    whole = f"list_filter(regexp_extract_all(t, '{_re2(pattern)}'), lambda m: NOT regexp_full_match(m, '{_re2(ENTITIES['jira_ticket'])}'))"
    return f"list_transform(list_transform({whole}, lambda m: regexp_extract(m, '{_re2(pattern)}', 1)), {named})"


def _snake(kind: str, value: str) -> str:
    return f"{kind} || '__' || regexp_replace(lower(trim({value})), '[^a-z0-9_]', '_', 'g')"


def _related(pattern: str, relation: str, direction: str) -> str:
    own = f"regexp_extract_all(t, '{_re2(pattern)}', 1)"
    if direction == "both":
        service = [_snake("'service'", f"p[{i}]") for i in (1, 2)]
        return f"list_transform(list_zip({own}, regexp_extract_all(t, '{_re2(pattern)}', 2)), lambda p: {{'from_id': {service[0]}, 'relation': '{relation}', 'to_id': {service[1]}, 'confidence': 0.8::DOUBLE}})"
    ends = ("id", _snake("'unknown'", "v")) if direction == "right" else (_snake("'service'", "v"), "id")
    return f"list_transform({own}, lambda v: {{'from_id': {ends[0]}, 'relation': '{relation}', 'to_id': {ends[1]}, 'confidence': 0.75::DOUBLE}})"


KINDS = ", ".join(_found(*e) for e in ENTITIES.items())
RELATED = ", ".join(_related(*r) for r in RELATIONS)
#: Accented letters count as word characters here, as they do in Unicode.
PLAIN = "regexp_replace(coalesce(lang, '') || ' ' || coalesce(text, ''), '[À-ɏ]', '_', 'g')"
DOC_RECORDS = f"docs AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS body, coalesce(lang, '') AS title, source, {PLAIN} AS t FROM documents)"
FOUND = f"found AS (SELECT id, unnest(list_concat({KINDS})) AS e FROM docs)"
PHRASES = f"phrases AS (SELECT *, list_sort(list_distinct(regexp_extract_all(t, '{_re2(PHRASE)}', 1))) AS p FROM docs)"
JUDGED = f"""
counts AS (SELECT id, body, source, p, len(list_concat({KINDS})) AS es, len(list_concat({RELATED})) AS rs FROM phrases),
judged AS (SELECT id, p, length(body) > 800 OR (es < 2 AND length(body) > 300) OR coalesce(source = 'confluence', FALSE) OR (rs = 0 AND es > 3) AS frontier FROM counts)
"""
MANIFEST = "manifest AS (SELECT doc_id AS n, doc_id::VARCHAR AS record_id, md5(coalesce(lang, '') || coalesce(text || CASE WHEN doc_id % 3 = 1 THEN '.' ELSE '' END, '')) AS content_hash, source FROM documents WHERE doc_id % 3 < 2)"
CHANGES = """
changes AS (SELECT d.doc_id::VARCHAR AS id, md5(coalesce(d.lang, '') || coalesce(d.text, '')) AS content_hash,
            CASE WHEN m.record_id IS NULL THEN 'new' WHEN m.content_hash <> md5(coalesce(d.lang, '') || coalesce(d.text, '')) THEN 'changed' ELSE 'unchanged' END AS change
            FROM documents d LEFT JOIN manifest m ON m.record_id = d.doc_id::VARCHAR)
"""
GRAPH = """
brands AS MATERIALIZED (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> ''),
held AS MATERIALIZED (SELECT o_orderkey, 'ORD-' || o_orderkey AS id, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
nodes AS MATERIALIZED (
  SELECT id, 'ticket' AS type, o_orderpriority AS title, NULL AS name, coalesce(c_name, '') AS owner, day AS timestamp, coalesce(o_orderpriority, '') AS priority, coalesce(o_orderstatus, '') AS status FROM held
  UNION ALL SELECT DISTINCT 'engineer__' || replace(lower(c_name), ' ', '_'), 'engineer', NULL, first_value(c_name) OVER (PARTITION BY replace(lower(c_name), ' ', '_') ORDER BY o_orderkey), NULL, NULL, NULL, NULL FROM held WHERE c_name <> ''
  UNION ALL SELECT DISTINCT 'service__' || replace(p_brand, '-', '_'), 'service', NULL, p_brand, NULL, NULL, NULL, NULL FROM brands JOIN orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (
  SELECT id AS from_id, 'engineer__' || replace(lower(c_name), ' ', '_') AS to_id, 'owned_by' AS relation, 0.99::DOUBLE AS confidence FROM held WHERE c_name <> ''
  UNION ALL SELECT 'ORD-' || l_orderkey, 'service__' || replace(p_brand, '-', '_'), 'mentions', 0.95::DOUBLE FROM brands JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges),
ended AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id),
degrees AS MATERIALIZED (SELECT n.id, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN ended USING (id))
"""


def _alias(names: dict[str, str]) -> str:
    return sql_values([(i, k, v) for i, (k, v) in enumerate(names.items())], "n, alias, canon")


def _service(x: str) -> str:
    return f"coalesce((SELECT canon FROM services WHERE alias = lower(trim({x}))), {x})"


def _owner(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN NULL ELSE coalesce((SELECT canon FROM owners WHERE alias = lower(trim({x}))), {x}) END"


def _mentions(x: str) -> str:
    return f"(SELECT coalesce(string_agg(canon, ',' ORDER BY m), '') FROM (SELECT canon, min(n) AS m FROM services WHERE contains(lower({x}), alias) GROUP BY canon))"


ALIASES = f"services AS (SELECT * FROM {_alias(SERVICES)}), owners AS (SELECT * FROM {_alias(OWNERS)})"


def _pick(values: list, n: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}]::VARCHAR[])[(({n}) % {len(values)}) + 1]"


def _name(n: str) -> str:
    return _pick(NAMES, n)


KNOWN = "MAP {{{}}}".format(", ".join(f"'{k}': '{v}'" for k, v in SERVICES.items()))
#: The given tables as the four exports: each row's services, owners and words follow from its key.
EXPORTS = rf"""
d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN replace({_pick([SERVICES[x] for x in NAMES], "doc_id")}, '-', '_') || '_guide_' || doc_id ELSE 'WIKI-' || doc_id END AS id,
      CASE WHEN doc_id % 2 = 0 THEN {_name("doc_id")} || ' handbook' ELSE 'Notes of ' || coalesce(source, '') END AS title,
      'Owner: ' || {_pick(WRITERS, "doc_id")} || CASE WHEN doc_id % 2 = 0 THEN ' (' || {_pick(MAILS, "doc_id")} || ')' ELSE '' END || E'\nOn-call: ' || {_pick(WRITERS, "doc_id + 3")}
        || E'\n## Dependencies\n- ' || {_name("doc_id + 1")} || ' (' || coalesce(lang, '') || E')\n- ' || {_name("doc_id + 7")} || E'\n# Text\n' || coalesce(text, '') AS body,
      '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS last_updated, doc_id AS n FROM documents),
t AS (SELECT 'OPS-' || o_orderkey AS id, {_name("o_orderkey")} || ' ' || lower(coalesce(substr(o_orderpriority, 3), '')) AS summary,
      CASE o_orderkey % 6 WHEN 0 THEN ' ' || {_name("o_orderkey")} || ' stands still, caused by ' || {_name("o_orderkey + 5")} || '. Fixes OPS-' || (o_orderkey - 1) || ' ' WHEN 1 THEN {_name("o_orderkey")} || ' depends on ' || {_name("o_orderkey + 5")} || ' and lags'
        WHEN 2 THEN 'Wording of ' || {_name("o_orderkey")} || ', see PR-' || o_orderkey % 1000 WHEN 3 THEN {_name("o_orderkey")} || ' unresponsive: timeout in ' || {_name("o_orderkey + 5")} || ' after ' || o_orderkey % 900 || ' ms'
        WHEN 4 THEN 'returned ' || (o_orderkey % 150 + 400) || ' to ' || {_pick(MAILS, "o_orderkey")} ELSE 'modified lib/x' || o_orderkey || '.go by the Shop Floor Manual' END AS description,
      {_pick(ASSIGNEES, "o_orderkey")} AS assignee, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'in progress' END AS status,
      CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'P' || coalesce(substr(o_orderpriority, 1, 1), '') END AS priority,
      CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_name("o_orderkey")}] WHEN 2 THEN [{_name("o_orderkey")}, 'unheard-of'] ELSE [{_name("o_orderkey")}, {_name("o_orderkey + 9")}] END AS services_affected,
      strftime(o_orderdate, '%Y-%m-%d') AS created, o_orderkey AS n FROM orders),
c AS (SELECT substr(md5(p_partkey::VARCHAR), 1, 12) AS sha,
      CASE p_partkey % 3 WHEN 0 THEN 'PR-' || p_partkey || ' lower ' || {_name("p_partkey")} || ' window to ' || coalesce(p_size::VARCHAR, '') || 'ms' WHEN 1 THEN 'Fixed OPS-' || p_partkey || ' in ' || {_name("p_partkey")} ELSE p_name END AS message,
      {_pick(WRITERS, "p_partkey")} AS author, {_name("p_partkey")} AS repo, CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE ['lib/' || lower(coalesce(p_type, '')) || '.go', 'ops/' || p_partkey || '.yml'] END AS files_changed,
      '2025-02-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS timestamp, CASE WHEN p_partkey % 3 = 0 THEN 'PR-' || p_partkey END AS pr, p_partkey AS n FROM part),
l AS (SELECT 'EV-' || event_id AS id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level, CASE WHEN event_id % 5 < 4 THEN {_name("event_id")} ELSE event_type END AS service,
      CASE event_id % 4 WHEN 0 THEN {_name("event_id")} || ' unresponsive: timeout on shelf ' || event_id % 100 || ' of ' || {_name("event_id + 5")} || ' after ' || event_id % 200 || 'ms, kept the old count and put the scan in a queue'
        WHEN 1 THEN (event_id % 150 + 400) || ' Too Many Requests from ' || {_name("event_id")} WHEN 2 THEN 'Vacuum Running since ' || coalesce(event_type, '') ELSE 'modified ' || coalesce(event_type, '') || '/weekly.json ' || coalesce(props, '') END AS message,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_id AS n FROM events)
"""
#: Where each export's records begin in the order of ingestion.
STRIDE = 1_000_000_000_000
RECORDS = rf"""
{ALIASES}, {EXPORTS},
d1 AS (SELECT *, list_filter(string_split(body, E'\n'), lambda x: contains(lower(x), 'owner:'))[1] AS line FROM d),
d2 AS (SELECT *, trim(regexp_replace(line, '^[^:]*:', '')) AS said FROM d1),
d3 AS (SELECT *, CASE WHEN contains(said, '(') AND contains(said, ')') THEN regexp_extract(said, '\(([^)]*)\)', 1) ELSE said END AS who FROM d2),
records AS (
  SELECT n AS ord, id, 'doc' AS type, title, trim(body, E' \t\n') AS body, {_owner("who")} AS owner, {_mentions("body")} AS services, last_updated AS timestamp, 'confluence' AS source, NULL AS priority, NULL AS status FROM d3
  UNION ALL SELECT {STRIDE} + n, id, 'ticket', summary, trim(description, E' \t\n'), {_owner("assignee")},
    array_to_string(list_transform(services_affected, lambda s: coalesce(map_extract_value({KNOWN}, lower(trim(s))), s)), ','), created, 'jira', priority, status FROM t
  UNION ALL SELECT {2 * STRIDE} + n, sha, 'commit', message, 'Author: ' || author || E'\nRepo: ' || repo || E'\nFiles changed: ' || array_to_string(files_changed, ', ') || E'\nPR: ' || coalesce(pr, 'N/A'), {_owner("author")}, {_service("repo")}, timestamp, 'github', NULL, NULL FROM c
  UNION ALL SELECT {3 * STRIDE} + n, id, 'log', '[' || level || '] ' || service || ': ' || substr(message, 1, 80), message, NULL, {_service("service")}, timestamp, 'logs', CASE WHEN level = 'ERROR' THEN 'P1' ELSE 'P2' END, 'active' FROM l)
"""


CORPUS = f"""
{RECORDS},
texts AS (SELECT *, regexp_replace(coalesce(title, '') || ' ' || coalesce(body, ''), '[À-ɏ]', '_', 'g') AS t FROM records),
lists AS (SELECT *, list_concat({KINDS}) AS es, list_concat({RELATED}) AS rs FROM texts),
entities AS (SELECT ord, id, n::INTEGER AS n, {_snake("e.type", "e.name")} AS entity_id, e.type AS type, e.name AS name FROM (SELECT ord, id, unnest(es) AS e, unnest(range(len(es))) AS n FROM lists)),
relations AS (SELECT ord, id, n::INTEGER AS n, r.from_id AS from_id, r.relation AS relation, r.to_id AS to_id, r.confidence AS confidence FROM (SELECT ord, id, unnest(rs) AS r, unnest(range(len(rs))) AS n FROM lists)),
said AS (SELECT ord, id, unnest(string_split(services, ',')) AS s, unnest(range(len(string_split(services, ',')))) AS i FROM records WHERE services <> ''),
node_writes AS (
  SELECT id, [ord, 0, 0] AS place, type, title, NULL AS name, coalesce(owner, '') AS owner, NULL AS extraction_source FROM records
  UNION ALL SELECT entity_id, [ord, 1, n], type, NULL, name, NULL, 'rule' FROM entities
  UNION ALL SELECT 'engineer__' || replace(lower(owner), ' ', '_'), [ord, 3, 0], 'engineer', NULL, owner, NULL, NULL FROM records WHERE owner <> ''
  UNION ALL SELECT 'service__' || replace(s, '-', '_'), [ord, 4, i], 'service', NULL, s, NULL, NULL FROM said),
nodes AS (SELECT * FROM node_writes QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1),
edge_writes AS (
  SELECT r.from_id, r.to_id, relation, confidence, 'rule' AS extraction_source, [r.ord, 2, n] AS place FROM relations r JOIN nodes a ON a.id = r.from_id JOIN nodes b ON b.id = r.to_id WHERE a.place < [r.ord, 2] AND b.place < [r.ord, 2]
  UNION ALL SELECT id, 'engineer__' || replace(lower(owner), ' ', '_'), 'owned_by', 0.99, NULL, [ord, 3, 0] FROM records WHERE owner <> ''
  UNION ALL SELECT id, 'service__' || replace(s, '-', '_'), 'mentions', 0.95, NULL, [ord, 4, i] FROM said)
"""


#: Relations to what no node is called lead to the entity or record whose id ends so, the least of several.
RESOLVED = rf"""
targets AS (SELECT id AS target FROM records UNION SELECT entity_id FROM entities),
keyed AS (SELECT regexp_replace(lower(regexp_replace(target, '^[a-z_]+?__', '')), '[^a-z0-9_]', '_', 'g') AS key, min(target) AS target FROM targets GROUP BY 1),
led AS (SELECT r.* REPLACE (coalesce(k.target, r.to_id) AS to_id) FROM relations r LEFT JOIN keyed k ON r.to_id = 'unknown__' || k.key),
resolved_writes AS (
  SELECT r.from_id, r.to_id, relation, [r.ord, 2, n] AS place FROM led r JOIN nodes a ON a.id = r.from_id JOIN nodes b ON b.id = r.to_id WHERE a.place < [r.ord, 2] AND b.place < [r.ord, 2]
  UNION ALL SELECT from_id, to_id, relation, place FROM edge_writes WHERE relation IN ('owned_by', 'mentions') AND extraction_source IS NULL),
resolved_edges AS (SELECT from_id, to_id, arg_max(relation, place) AS relation FROM resolved_writes GROUP BY from_id, to_id)
"""
#: What is the same by how ids are made: chains of one link, so that a representative is told by its place among its neighbours.
SAME = rf"""
spelled AS (SELECT 'service__' || replace(alias, '-', '_') AS a, 'service__' || replace(canon, '-', '_') AS b FROM services
  UNION SELECT 'engineer__' || replace(lower(alias), ' ', '_'), 'engineer__' || replace(lower(canon), ' ', '_') FROM owners UNION SELECT {_snake("'email'", "alias")}, 'engineer__' || replace(lower(canon), ' ', '_') FROM owners
  UNION SELECT {_snake("'jira_ticket'", "id")}, id FROM nodes WHERE type = 'ticket' UNION SELECT {_snake("'commit_sha'", "id")}, id FROM nodes WHERE type = 'commit'),
pairs AS (SELECT s.a, s.b FROM spelled s WHERE a <> b AND a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)),
members AS (SELECT a AS id, b AS hub FROM pairs UNION SELECT b, b FROM pairs),
placed AS (SELECT m.id, hub, coalesce(type NOT IN ('ticket', 'commit', 'doc', 'log'), TRUE) AS later, place FROM members m JOIN nodes n ON n.id = m.id),
same AS (SELECT id, first_value(id) OVER (PARTITION BY hub ORDER BY later, place[1], id) AS same FROM placed QUALIFY id <> same),
merged AS (SELECT coalesce(x.same, from_id) AS from_id, coalesce(y.same, to_id) AS to_id, relation, CASE relation WHEN 'owned_by' THEN 0.99 WHEN 'mentions' THEN 0.95 WHEN 'depends_on' THEN 0.80 ELSE 0.75 END AS confidence
           FROM resolved_edges LEFT JOIN same x ON x.id = from_id LEFT JOIN same y ON y.id = to_id)
"""
BOTH = "ways AS (SELECT from_id AS a, to_id AS b FROM edge_writes UNION SELECT to_id, from_id FROM edge_writes)"


def _of_service(one, services: tuple[str, ...]) -> str:
    """A question's answers for each of the services: `one` gives the SQL from a service's name and how it is looked for."""
    arms = []
    for name in services:
        key = name.lower().replace("-", "_")
        place = f"CASE WHEN id = 'service__{name.replace('-', '_')}' THEN 0 WHEN id = 'service__{name}' THEN 1 WHEN type = 'service' AND (contains(lower(id), '{key}') OR contains(lower(coalesce(name, '')), '{key}')) THEN 2 END"
        known = f"known AS (SELECT id FROM (SELECT id, place[1] AS ord, {place} AS p FROM nodes) WHERE p IS NOT NULL ORDER BY p, ord, id LIMIT 1), near AS (SELECT DISTINCT a AS id FROM ways JOIN known ON b = known.id)"
        arms.append(f"SELECT *, '{name}' AS service FROM (WITH {known} {one(name, key)})")
    return f"WITH {CORPUS}, {BOTH} " + " UNION ALL ".join(arms)


def _titled(name: str) -> str:
    return f"list_contains(string_split({_mentions('title')}, ','), '{name}')"


def _owner_of(resolved: bool):
    def one(name: str, key: str) -> str:
        about = _titled(name) if resolved else "FALSE"
        return rf""", best AS (SELECT owner, source FROM (SELECT *, {about} AS about FROM records) WHERE coalesce(owner, '') <> '' AND (contains(lower(id), '{key}') OR id IN (FROM near) OR about) ORDER BY NOT about, source <> 'confluence', ord, id LIMIT 1),
        said AS (SELECT ord, id, unnest(string_split(substr(body, 1, 500), E'\n')) AS line, unnest(range(len(string_split(substr(body, 1, 500), E'\n')))) AS i FROM records WHERE source = 'confluence' AND owner = (SELECT owner FROM best)),
        calls AS (SELECT *, trim(regexp_replace(line, '^[^:]*:', '')) AS whom FROM said WHERE (contains(lower(line), 'on-call:') OR contains(lower(line), 'escalation')) AND contains(line, ':'))
        SELECT (SELECT owner FROM best) AS "primary", (SELECT whom FROM calls ORDER BY ord DESC, id DESC, i DESC LIMIT 1) AS escalation, (SELECT source FROM best) AS source"""

    return one


def _changes_of(name: str, key: str) -> str:
    return f"SELECT id, timestamp, coalesce(owner, '') AS owner FROM records WHERE type = 'commit' AND (contains(lower(title), '{key}') OR contains(lower(substr(body, 1, 500)), '{key}') OR id IN (SELECT a FROM ways WHERE contains(lower(b), '{key}'))) ORDER BY timestamp DESC, ord LIMIT 5"


def _incidents_of(resolved: bool):
    def one(name: str, key: str) -> str:
        about = "id IN (FROM near)" if resolved else f"(contains(lower(title), '{key}') OR contains(lower(substr(body, 1, 500)), '{key}') OR contains(lower(id), '{key}'))"
        return f"SELECT id, coalesce(priority, '') AS priority, coalesce(status, '') AS status FROM records WHERE type = 'ticket' AND coalesce(status, '') NOT IN {CLOSED} AND {about}"

    return one


def _dependencies_of(resolved: bool):
    def one(name: str, key: str) -> str:
        about = _titled(name) if resolved else f"contains(lower(id), '{key}')"
        return rf""", said AS (SELECT id, unnest(string_split(lower(substr(body, 1, 500)), E'\n')) AS line, unnest(range(len(string_split(substr(body, 1, 500), E'\n')))) AS i FROM records WHERE type = 'doc' AND {about}),
        marked AS (SELECT *, contains(line, 'dependencies') AS heading, starts_with(trim(line), '-') AS bullet FROM said),
        states AS (SELECT *, last_value(CASE WHEN heading THEN TRUE WHEN NOT bullet AND starts_with(line, '#') THEN FALSE END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS listing FROM marked),
        named AS (SELECT trim(string_split(regexp_replace(trim(line), '^[- ]+', ''), '(')[1]) AS dependency FROM states WHERE listing AND bullet AND NOT heading)
        SELECT DISTINCT dependency FROM named WHERE dependency <> '' AND EXISTS (FROM known)"""

    return one


#: What assistants say in conversations, with citations put in.
ANSWERS = r"""
answers AS (SELECT conv_id || '-' || turn AS id, (conv_id % 6)::INTEGER AS n, substr(coalesce(text, ''), 1, 60) AS quoted,
            regexp_replace(regexp_replace(text, '\.\n', ' [' || turn % 7 || E'].\n', 'g'), '\. ', ' [' || conv_id % 4 || ']. ', 'g') AS answer FROM conversations WHERE role = 'assistant')
"""
#: An answer's citations: numbers beyond the sources are stripped with their sentences, one after the other.
CITED = rf"""
{ANSWERS},
said AS (SELECT id, n, coalesce(answer, '') AS answer, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d+)\]', 1), lambda r: regexp_replace(r, '^0+(\d)', '\1'))) AS refs FROM answers),
judged AS (SELECT *, list_sort(list_filter(refs, lambda r: TRY_CAST(r AS BIGINT) IS NULL OR TRY_CAST(r AS BIGINT) NOT BETWEEN 1 AND n)) AS bad FROM said)
SELECT id, trim(list_reduce(list_prepend(answer, bad), lambda text, r: regexp_replace(text, '[^.!?\n]*\[' || r || '\][^.!?\n]*[.!?\n]?', '', 'g')), E' \t\n') AS answer,
       array_to_string(list_filter(list_transform(range(1, n + 1), lambda i: i::VARCHAR), lambda i: list_contains(refs, i)), ',') AS refs FROM judged
"""
#: A model's answer: without fences, else what lies between the first and the last brace.
REPAIRED = rf"""
said AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '{{"entities": [{{"id": "' || coalesce(event_type, '') || '", "type": "service", "name": "A"}}], "relationships": []}}'
         WHEN 1 THEN E'```json\n{{"entities": [{{"id": "' || coalesce(event_type, '') || '"}}], "relationships": [{{"from_id": "' || coalesce(event_type, '') || E'", "relation": "owns", "to_id": "c"}}]}}\n```'
         WHEN 2 THEN 'Here it is: {{"entities": [], "relationships": [{{"from": "' || coalesce(event_type, '') || '", "relation": "affects", "to": "y"}}]}} as asked.' WHEN 3 THEN '{{"entities": [{{"id": "' || coalesce(event_type, '') || '"' ELSE 'I found nothing of ' || coalesce(event_type, '') END AS raw FROM events),
bare AS (SELECT id, trim(regexp_replace(regexp_replace(raw, '(?m)^```(?:json)?\s*', '', 'g'), '(?m)\s*```$', '', 'g'), E' \t\n') AS text FROM said),
best AS (SELECT id, CASE WHEN starts_with(text, '{{') AND json_valid(text) THEN text WHEN json_valid(regexp_extract(text, '(?s)\{{.*\}}')) THEN regexp_extract(text, '(?s)\{{.*\}}') END AS j FROM bare)
SELECT id, coalesce(json_array_length(j, '$.entities'), 0)::INTEGER AS entities, coalesce(json_array_length(j, '$.relationships'), 0)::INTEGER AS relationships FROM best
"""


ORACLES: dict[str, str] = {
    "chunk_documents": f"WITH {FILES} SELECT * FROM chunks",
    "store_stats": f"WITH {FILES} SELECT count(*) AS chunk_count, count(DISTINCT doc_id) AS doc_count, list_sort(list(DISTINCT filename)) AS filenames FROM chunks",
    "stored_files": f"WITH {FILES} SELECT filename, count(*) AS chunks FROM chunks GROUP BY filename",
    "edge_pages": f"WITH {GRAPH} SELECT id, direction, count(*) AS edges, TRUE AS short FROM (SELECT from_id AS id, 'out' AS direction FROM edges UNION ALL SELECT to_id, 'in' FROM edges) GROUP BY id, direction",
    "benchmark_mentions": r"""WITH a AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '\S+')[1:3], ' ') AS alias FROM benchmark)
        SELECT doc_id, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (item_id IS NOT NULL), '') AS items FROM documents LEFT JOIN a ON contains(lower(coalesce(text, '')), alias) GROUP BY doc_id""",
    "doc_identity_collisions": "SELECT substr(sha256(source || substr(coalesce(text, ''), 1, 200)), 1, 12) AS doc_id, count(*) AS documents, min(documents.doc_id) AS first_document FROM documents GROUP BY 1 HAVING count(*) > 1",
    "bm25_term_stats": rf"""WITH {FILES}, terms AS (SELECT list_distinct(regexp_extract_all(lower(text), '\S+')) AS t FROM chunks), dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM terms) GROUP BY term),
        raws AS (SELECT term, df, ln((SELECT count(*) FROM terms) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs)
        SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raws""",
    "bm25_topk": f"WITH {FILES}, {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lexical",
    "stored_bm25": f"WITH {FILES}, {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lexical",
    "chunks_by_id": f"WITH {FILES}, {BM25} SELECT chunk_id, filename, text, total_chunks FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM lexical WHERE rank = 1)",
    "vector_search_docs": f"WITH {FILES}, {VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM near",
    "hybrid_search": f"WITH {FILES}, {BM25}, {VECTOR}, {FUSED} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(rrf, 6) AS rrf, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, round(coalesce(bm25_score, vector_score), 6) AS score FROM fused",
    "rerank_lexical": f"WITH {FILES}, {BM25}, {VECTOR}, {FUSED}, {RERANKED} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM reranked",
    "retrieval_funnel": f"""WITH {FILES}, {BM25}, {VECTOR}, {FUSED}, {RERANKED} SELECT item_id AS query_id, (SELECT count(*) FROM lexical x WHERE x.query_id = item_id) AS bm25_hits, (SELECT count(*) FROM near x WHERE x.query_id = item_id) AS vector_hits,
        (SELECT count(*) FROM fused x WHERE x.query_id = item_id) AS after_rrf, (SELECT count(*) FROM reranked x WHERE x.query_id = item_id) AS after_rerank FROM benchmark""",
    "cited_answers": f"WITH {FILES}, {BM25}, {VECTOR}, {FUSED}, {RERANKED} SELECT query_id, string_agg(rank || ':' || chunk_id, ' ' ORDER BY rank) AS cited FROM reranked WHERE rank <= 2 GROUP BY query_id",
    "asked_answers": f"WITH {FILES}, {BM25}, {VECTOR}, {FUSED}, {RERANKED} SELECT query_id, 'It says so [1]. That is all.' AS answer, '1:' || chunk_id AS cited FROM reranked WHERE rank = 1",
    "vector_topk": f"WITH {COSINE} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM scored QUALIFY rank <= 50",
    "vector_topk_filtered": f"WITH {COSINE} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM scored WHERE label = 3 QUALIFY rank <= 5",
    "quantised_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
    "near_dup_pairs": f"WITH {FIRST_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM kept WHERE similarity >= 0.3",
    "dedup_greedy": f"""WITH RECURSIVE {PAIRS}, links AS MATERIALIZED (SELECT a, b FROM pairs WHERE similarity >= 0.3),
        ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
        before AS (SELECT i.n, i.vec_id, coalesce(list(l.a) FILTER (l.a IS NOT NULL), []) AS near FROM ids i LEFT JOIN links l ON l.b = i.vec_id GROUP BY ALL),
        walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL
                 SELECT b.n, CASE WHEN len(list_intersect(w.kept, b.near)) = 0 THEN list_append(w.kept, b.vec_id) ELSE w.kept END FROM walk w JOIN before b ON b.n = w.n + 1)
        SELECT unnest(kept) AS vec_id FROM walk WHERE n = (SELECT count(*) FROM ids)""",
    "fuse_rankings": """WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50), y AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50),
        f AS (SELECT coalesce(x.vec_id, y.vec_id) AS v, x.r AS ra, y.r AS rb, coalesce(1.0::DOUBLE / (60 + x.r), 0) + coalesce(1.0::DOUBLE / (60 + y.r), 0) AS rrf FROM x FULL JOIN y ON x.vec_id = y.vec_id)
        SELECT 1 AS query_id, v::VARCHAR AS chunk_id, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY round(rrf, 12) DESC, ra NULLS LAST, rb NULLS LAST)::INTEGER AS rank FROM f QUALIFY rank <= 20""",
    "normalize_events": f"""WITH {ALIASES} SELECT 'LOG-' || event_id AS id, '[' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' || event_type || ': ' || substr(props, 1, 80) AS title, props AS body,
        {_service("event_type")} AS services, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN event_type = 'error' THEN 'P1' ELSE 'P2' END AS priority, 'active' AS status FROM events""",
    "normalize_union": f"WITH {RECORDS} SELECT * EXCLUDE (ord) FROM records",
    "entities_documents": f"WITH {DOC_RECORDS}, {FOUND} SELECT id, {_snake('e.type', 'e.name')} AS entity_id, e.type AS type, e.name AS name FROM found",
    "unresolved_phrases": f"WITH {DOC_RECORDS}, {PHRASES} SELECT id, array_to_string(p, ', ') AS unresolved_text FROM phrases WHERE len(p) > 0",
    "mentions_scan": f"WITH {ALIASES} SELECT page_id, {_mentions('html')} AS services FROM pages",
    "needs_frontier": f"WITH {DOC_RECORDS}, {PHRASES}, {JUDGED} SELECT id, frontier FROM judged",
    "tier_costs": f"""WITH {DOC_RECORDS}, {PHRASES}, {JUDGED}, t AS (SELECT CASE WHEN frontier THEN 'llm_frontier' WHEN len(p) > 0 THEN 'llm_cheap' ELSE 'rule' END AS tier FROM judged)
        SELECT v.tier, count(t.tier) AS records, round(count(t.tier) * price, 6) AS cost FROM (VALUES ('cache', 0.0::DOUBLE), ('rule', 0.0), ('llm_cheap', 0.0002), ('llm_frontier', 0.003)) AS v(tier, price) LEFT JOIN t ON t.tier = v.tier GROUP BY v.tier, price""",
    "cascade_tiers": f"""WITH {CORPUS}, known AS (SELECT *, len(es) AS n, len(rs) AS r, len(regexp_extract_all(t, '{_re2(PHRASE)}', 1)) > 0 AS cheap FROM lists),
        asked AS (SELECT *, length(body) > 800 OR (n + cheap::INTEGER < 2 AND length(body) > 300) OR source = 'confluence' OR (r = 0 AND n + cheap::INTEGER > 3) AS frontier FROM known),
        tiers AS (SELECT *, CASE WHEN type = 'log' THEN 'cache' WHEN type = 'commit' THEN 'rule' WHEN frontier THEN 'llm_frontier' WHEN cheap THEN 'llm_cheap' ELSE 'rule' END AS tier FROM asked)
        SELECT id, tier, type <> 'commit' AS processed, CASE WHEN tier = 'cache' THEN 0 ELSE n + starts_with(tier, 'llm')::INTEGER END::INTEGER AS entities, CASE WHEN tier = 'cache' THEN 0 ELSE r END::INTEGER AS relationships FROM tiers""",
    "stored_chunks": f"WITH {FILES} SELECT chunk_id, filename, chunk_index FROM chunks",
    "upserted_manifest": """SELECT doc_id::VARCHAR AS record_id, md5(coalesce(lang, '') || coalesce(text, '')) AS content_hash, source, CASE WHEN doc_id % 3 = 0 THEN 'rule' ELSE 'llm_cheap' END AS tier_used,
        CASE WHEN doc_id % 3 = 0 THEN '2026-01-01 00:00:00' ELSE '2026-01-02 00:00:00' END AS indexed_at FROM documents""",
    "stored_cache": """SELECT md5(coalesce(lang, '') || ' ' || coalesce(text, '')) AS text_hash, '{"entities":[],"relationships":[]}' AS result_json, CASE WHEN bool_or(doc_id % 3 > 0) THEN 'llm_cheap' ELSE 'rule' END AS tier_used,
        CASE WHEN bool_or(doc_id % 3 > 0) THEN '2026-01-02 00:00:00' ELSE '2026-01-01 00:00:00' END AS created_at FROM documents GROUP BY 1""",
    "source_blocks": rf"""WITH {ANSWERS} SELECT id, array_to_string(list_transform(range(1, n + 1), lambda i: '[' || i || '] ' || id || '.md, part ' || i || '/' || n || E':\n' || quoted), E'\n\n') AS block FROM answers""",
    "change_detection": f"WITH {MANIFEST}, {CHANGES} SELECT id, change, content_hash FROM changes",
    "streamed_changes": f"WITH {MANIFEST}, {CHANGES} SELECT record_id AS id, 'new' AS change, content_hash FROM manifest UNION ALL SELECT id, change, content_hash FROM changes WHERE change <> 'unchanged'",
    "change_stats": f"WITH {MANIFEST}, {CHANGES} SELECT count(*) AS total, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged FROM changes",
    "manifest_rows": f"WITH {MANIFEST} SELECT record_id, content_hash, source, 'rule' AS tier_used, '2026-01-01 00:00:00' AS indexed_at FROM manifest",
    "last_build": f"WITH {MANIFEST}, built AS (SELECT '2026-01-01 00:00:00' AS indexed_at FROM manifest) SELECT max(indexed_at) AS last_build FROM built",
    "cache_keys": "SELECT doc_id::VARCHAR AS id, md5(coalesce(lang, '') || ' ' || coalesce(text, '')) AS text_hash, md5(coalesce(lang, '') || coalesce(text, '')) AS content_hash FROM documents",
    "graph_nodes": f"WITH {GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM edges",
    "node_type_counts": f"WITH {GRAPH} SELECT type, count(*) AS nodes FROM nodes GROUP BY type",
    "relation_counts": f"WITH {GRAPH} SELECT relation, count(*) AS edges FROM edges GROUP BY relation",
    "graph_size": f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "health_overview": f"""WITH {GRAPH}, t AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'rule' ELSE 'llm_cheap' END AS tier FROM documents)
        SELECT 'type' AS what, type AS name, count(*) AS n, NULL::DOUBLE AS cost FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*), NULL FROM edges GROUP BY relation
        UNION ALL SELECT 'tier', v.tier, count(t.tier), round(count(t.tier) * price, 6) FROM (VALUES ('cache', 0.0::DOUBLE), ('rule', 0.0), ('llm_cheap', 0.0002), ('llm_frontier', 0.003)) AS v(tier, price) LEFT JOIN t ON t.tier = v.tier GROUP BY v.tier, price""",
    "node_degree": f"WITH {GRAPH} SELECT id, degree FROM degrees",
    "node_labels": """WITH held AS (SELECT 'ORD-' || o_orderkey AS id, o_orderkey, o_orderpriority AS title, 'engineer__' || replace(lower(c_name), ' ', '_') AS who, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
        brands AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_brand <> ''),
        ends AS (SELECT id, 'ticket' AS type, title AS t, (c_name <> '')::INTEGER AS n FROM held UNION ALL SELECT who, 'engineer', c_name, 1 FROM held WHERE c_name <> ''
                 UNION ALL SELECT 'ORD-' || l_orderkey, 'ticket', NULL, 1 FROM brands UNION ALL SELECT 'service__' || replace(p_brand, '-', '_'), 'service', p_brand, 1 FROM brands),
        summed AS (SELECT id, type, coalesce(nullif(min(t), ''), id) AS t, coalesce(sum(n), 0)::BIGINT AS degree FROM ends GROUP BY id, type)
        SELECT id, type, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '…' ELSE t END AS label, degree FROM summed""",
    "ego_2hop": f"""WITH {GRAPH}, h1 AS (SELECT DISTINCT b AS id FROM ends WHERE a = 'ORD-1'), h2 AS (SELECT DISTINCT b AS id FROM ends WHERE a IN (SELECT id FROM h1)),
        near AS (SELECT id, min(hop) AS hop FROM (SELECT 'ORD-1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id)
        SELECT n.id, hop, coalesce(nullif(title, ''), nullif(name, ''), n.id) AS title, (SELECT count(*) FROM edges WHERE from_id = n.id)::INTEGER AS outgoing, (SELECT count(*) FROM edges WHERE to_id = n.id)::INTEGER AS incoming FROM nodes n JOIN near USING (id)""",
    "ego_first": f"""WITH {GRAPH}, h1 AS (SELECT DISTINCT b AS id FROM ends WHERE a = 'ORD-1'), h2 AS (SELECT DISTINCT b AS id FROM ends WHERE a IN (SELECT id FROM h1)),
        near AS (SELECT id, min(hop) AS hop FROM (SELECT 'ORD-1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id),
        firsts AS (SELECT id, o_orderkey AS ord FROM held UNION ALL SELECT 'engineer__' || replace(lower(c_name), ' ', '_'), o_orderkey FROM held WHERE c_name <> '' UNION ALL SELECT 'service__' || replace(p_brand, '-', '_'), l_orderkey FROM brands JOIN orders ON l_orderkey = o_orderkey),
        placed AS (SELECT near.id, hop, min(ord) AS ord FROM near JOIN firsts USING (id) GROUP BY ALL)
        SELECT id, hop, row_number() OVER (ORDER BY hop, ord, id)::INTEGER AS place FROM placed QUALIFY place <= 10""",
    "loaded_graph": f"WITH {GRAPH} SELECT * FROM edges",
    "exported_graph": f"WITH {GRAPH} SELECT * FROM nodes",
    "recent_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 5",
    "simple_questions": r"SELECT conv_id, turn, ({}) AND len(regexp_extract_all(coalesce(text, ''), '\S+')) < 8 AS simple FROM conversations WHERE role = 'user'".format(" OR ".join(f"starts_with(lower(coalesce(text, '')), '{s}')" for s in SIMPLE)),
    "event_json": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings",
    "rerank_scores": r"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '\S+')) AS q FROM benchmark ORDER BY item_id LIMIT 1)
        SELECT doc_id, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\S+')))) / len(q), 6) AS score FROM documents, q""",
    "entities_fixture": f"WITH {CORPUS} SELECT id, n, entity_id, type, name FROM entities",
    "relations_fixture": f"WITH {CORPUS} SELECT id, n, from_id, relation, to_id, confidence FROM relations",
    "corpus_nodes": f"WITH {CORPUS} SELECT id, type, title, name, owner, extraction_source FROM nodes",
    "corpus_edges": f"WITH {CORPUS} SELECT from_id, to_id, arg_max(relation, place) AS relation, arg_max(confidence, place) AS confidence, max(extraction_source) AS extraction_source FROM edge_writes GROUP BY from_id, to_id",
    "corpus_edges_resolved": f"WITH {CORPUS}, {RESOLVED} SELECT from_id, to_id, relation FROM resolved_edges WHERE relation NOT IN ('mentions', 'owned_by')",
    "corpus_same_as": f"WITH {CORPUS}, {RESOLVED}, {SAME} SELECT id, same FROM same",
    "merged_edges": f"WITH {CORPUS}, {RESOLVED}, {SAME} SELECT from_id, to_id, first(relation ORDER BY confidence DESC, relation) AS relation FROM merged WHERE from_id <> to_id GROUP BY from_id, to_id",
    "json_repair": f"WITH {REPAIRED}",
    "citation_check": f"WITH {CITED}",
    "find_owner": _of_service(_owner_of(False), ("fraud-detection", "inventory-service", "nowhere")),
    "find_owner_resolved": _of_service(_owner_of(True), ("fraud-detection", "inventory-service")),
    "recent_changes": _of_service(_changes_of, ("inventory-service", "redis-cache")),
    "active_incidents": _of_service(_incidents_of(False), ("fraud-detection", "inventory")),
    "active_incidents_resolved": _of_service(_incidents_of(True), ("fraud-detection", "inventory-service")),
    "dependencies": _of_service(_dependencies_of(False), ("inventory-service", "redis-cache")),
    "dependencies_resolved": _of_service(_dependencies_of(True), ("inventory-service", "fraud-detection")),
}
