"""DuckDB SQL giving the expected rows of the named queries.

The SQL is written from the meaning of each operator, not from its Spark plan:
texts are built so that the answer is known without parsing them.
"""

from __future__ import annotations

_CLASSES = r"""
cls AS (
  SELECT doc_id, lang, source, text,
    (doc_id % 12)::VARCHAR || '.0' AS version,
    'C' || (doc_id % 7)::VARCHAR AS simple_name,
    'org.' || lang || '.core.C' || (doc_id % 7)::VARCHAR AS fqn,
    CASE WHEN doc_id % 7 = 4 OR doc_id % 11 = 0 THEN 'mirror/' || source
         WHEN doc_id % 7 < 2 AND doc_id % 5 = 0 THEN 'org/' || lang || '/core'
         ELSE 'org/' || lang || '/' || source END
      || '/' || (doc_id % 12)::VARCHAR || '.0/' || source || '-' || (doc_id % 12)::VARCHAR || '.0.jar' AS jar_path,
    'package org.' || lang || '.core;' || chr(10) || chr(10) || 'public class C' || (doc_id % 7)::VARCHAR
      || ' {' || chr(10) || '// ' || text || chr(10) || '}' || chr(10) AS content
  FROM documents
)"""

_ENTRIES = r"""
ent AS (
  SELECT doc_id, jar_path, fqn, simple_name, doc_id AS entry_idx,
    CASE doc_id % 9
      WHEN 0 THEN 'org/' || lang || '/core/' || simple_name || '$Inner.class'
      WHEN 1 THEN 'META-INF/MANIFEST.MF'
      WHEN 2 THEN simple_name || '.class'
      WHEN 3 THEN 'org/' || lang || '/core/' || simple_name || '.class.class'
      WHEN 4 THEN 'org\' || lang || '\core\' || simple_name || '.class'
      WHEN 5 THEN 'org/' || lang || '/core/package-info.class'
      ELSE 'org/' || lang || '/core/' || simple_name || '.class' END AS entry_name
  FROM cls
)"""

_QUERIES = r"""
req AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'ant.' || simple_name WHEN 5 THEN simple_name ELSE fqn END AS class_name
  FROM cls
)"""

_SUFFIX = r"""
sfx AS (
  SELECT DISTINCT parse_filename(entry_name)[:-7] AS simple_name, jar_path,
    replace(CASE WHEN doc_id % 9 = 3 THEN entry_name[:-13] ELSE entry_name[:-7] END, '/', '.') AS fqn
  FROM ent
  WHERE suffix(entry_name, '.class') AND NOT contains(entry_name, '$') AND contains(entry_name, '/')
    AND parse_filename(entry_name)[:-7] IN (SELECT simple_name FROM cls)
),
per_jar AS (SELECT simple_name, jar_path, min(fqn) AS fqn FROM sfx GROUP BY ALL),
counted AS (SELECT simple_name, fqn, count(*) AS artifacts FROM per_jar GROUP BY ALL),
best AS (
  SELECT * FROM counted
  QUALIFY row_number() OVER (PARTITION BY simple_name ORDER BY artifacts DESC, fqn DESC) = 1
)"""

_CACHE = r"""
cache AS (
  SELECT fqn, jar_path, content FROM cls
  QUALIFY row_number() OVER (PARTITION BY fqn, jar_path ORDER BY doc_id DESC) = 1
),
srcs AS (
  SELECT fqn, jar_path, doc_id, content FROM cls
  QUALIFY row_number() OVER (PARTITION BY fqn, jar_path ORDER BY doc_id) = 1
),
dec AS (
  SELECT fqn, jar_path, content FROM cls
  QUALIFY row_number() OVER (PARTITION BY fqn, jar_path ORDER BY doc_id) = 1
),
texts AS (
  SELECT d.fqn, d.jar_path, c.content IS NOT NULL AS cache_hit,
    CASE WHEN c.content IS NOT NULL OR s.content IS NOT NULL THEN 'sources-jar' ELSE 'decompiled' END AS source,
    coalesce(c.content, s.content, d.content) AS content,
    s.content AS original
  FROM dec d
  LEFT JOIN (SELECT * FROM cache WHERE split_part(jar_path, '/', -2)::DOUBLE % 2 <> 0) c USING (fqn, jar_path)
  LEFT JOIN (SELECT * FROM srcs WHERE split_part(jar_path, '/', -2)::DOUBLE % 3 <> 0) s USING (fqn, jar_path)
),
found AS (
  SELECT fqn, split_part(jar_path, '/', -2) AS version, jar_path, sha256(content) AS content_hash,
    cache_hit, source, 'registry' AS lookup_source
  FROM texts WHERE fqn IN (SELECT class_name FROM req)
)"""

_LIVE = r"""
live AS (SELECT * FROM entries WHERE split_part(jar_path, '/', -2)::DOUBLE % 5 <> 0)"""

_ENT_IS_LIVE = "ent AS (SELECT * FROM live)"

_BATCH = r"""
asked AS (
  SELECT DISTINCT class_name AS name, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 12)::VARCHAR || '.0' END AS wanted FROM req
),
held AS (
  SELECT DISTINCT fqn, jar_path FROM ent JOIN (SELECT DISTINCT fqn AS name FROM cls) ON entry_name = replace(name, '.', '/') || '.class'
),
listed AS (
  SELECT name, wanted, fqn, jar_path FROM asked JOIN known ON name = fqn SEMI JOIN held USING (fqn, jar_path)
  WHERE wanted IS NULL OR split_part(jar_path, '/', -2) = wanted
),
missed AS (SELECT * FROM asked WHERE contains(name, '.') AND NOT EXISTS (
  SELECT 1 FROM listed l WHERE l.name = asked.name AND l.wanted IS NOT DISTINCT FROM asked.wanted)),
tiered AS (
  SELECT fqn, jar_path, CASE WHEN starts_with(jar_path, 'org/' || split_part(fqn, '.', 2) || '/core/') THEN 0
    WHEN starts_with(jar_path, 'org/' || split_part(fqn, '.', 2) || '/') THEN 1 ELSE 2 END AS tier FROM held
),
hits AS (
  SELECT name, wanted, fqn, jar_path, 'registry' AS lookup_source FROM listed
  UNION ALL
  SELECT name, wanted, fqn, jar_path, 'scan' FROM missed
  JOIN (SELECT * FROM tiered QUALIFY tier = min(tier) OVER (PARTITION BY fqn)) ON name = fqn
  WHERE wanted IS NULL OR split_part(jar_path, '/', -2) = wanted
  UNION ALL
  SELECT name, wanted, fqn, jar_path, 'scan' FROM asked JOIN best ON name = simple_name JOIN per_jar USING (simple_name, fqn)
  WHERE wanted IS NULL OR split_part(jar_path, '/', -2) = wanted
),
answers AS (
  SELECT h.*, split_part(jar_path, '/', -2) AS version, sha256(content) AS content_hash, cache_hit, source,
    row_number() OVER (PARTITION BY name, wanted ORDER BY split_part(jar_path, '/', -2), jar_path) AS position,
    count(*) OVER (PARTITION BY name, wanted) AS n
  FROM hits h JOIN texts USING (fqn, jar_path)
)"""

_KNOWN = r"""
known AS (
  SELECT fqn, jar_path, min(doc_id) AS seq FROM cls WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL
)"""

_PATHS = r"""
paths AS (
  SELECT doc_id, CASE doc_id % 6
      WHEN 0 THEN jar_path[:-5] || '-sources.jar' WHEN 1 THEN jar_path[:-5] || '.JAR'
      WHEN 2 THEN jar_path || '.zip' WHEN 3 THEN source || '.jar'
      WHEN 4 THEN '/' || source || '.jar' ELSE jar_path END AS path,
    jar_path, source, version
  FROM cls
)"""

_LOG = r"""
log AS (
  SELECT 'user/' || user_id::VARCHAR || '.jar' AS jar_path, epoch(ts)::BIGINT AS epoch_round, ts, event_id,
    floor(epoch_us(ts) / 1000000)::BIGINT AS epoch,
    json_extract_string(props, '$.k')::BIGINT AS class_count,
    event_type = 'signup' AND json_extract_string(props, '$.k')::BIGINT < 5 AS warmed
  FROM events
),
state AS (
  SELECT jar_path, count(*) FILTER (NOT warmed) AS access_count,
    coalesce(max(epoch) FILTER (NOT warmed), 0) AS last_access, bool_or(warmed) AS warmed,
    coalesce(arg_max(class_count, (ts, event_id)) FILTER (warmed), 0) AS class_count
  FROM log GROUP BY jar_path
),
numbered AS (
  SELECT *, count(*) FILTER (NOT warmed) OVER before AS n,
    coalesce(bool_or(warmed) OVER before, false) AS warm
  FROM log
  WINDOW before AS (PARTITION BY jar_path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)"""

_MTIME = r"""
modified AS (
  SELECT 'u' || user_id::VARCHAR || '/' || json_extract_string(props, '$.k') || '.jar' AS jar_path, user_id,
    epoch_us(ts) * 1000 AS moment FROM events
),
new_t AS (SELECT jar_path, max(moment) AS mtime_ns FROM modified GROUP BY 1),
old_t AS (
  SELECT jar_path, CASE WHEN min(user_id) % 3 = 0 THEN max(moment) ELSE min(moment) END AS mtime_ns
  FROM modified GROUP BY 1 HAVING count(*) > 1
)"""

_JAVA = r"""
java AS (
  SELECT doc_id, lang, source, simple_name, string_split(text, chr(10)) AS lines FROM cls
)"""

_OUTPUT = r"""
outp AS (
  SELECT doc_id, lang, '/*' || chr(10) || ' * Decompiled with CFR 0.152.' || chr(10) || ' */' || chr(10) AS banner,
    'package org.' || lang || '.alt;' || chr(10) || chr(10) || 'interface I<T> {' || chr(10) || '}' AS second,
    content, fqn
  FROM cls
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_CLASS_OF_ENTRY = """replace(replace(CASE WHEN doc_id % 9 = 3 THEN entry_name[:-13] ELSE entry_name[:-7] END,
    '/', '.'), chr(92), '.')"""


def oracle_sql() -> dict[str, str]:
    requests = """SELECT jar_path, event_id, (CASE WHEN n >= {t} THEN 2 ELSE 1 END)::BIGINT AS priority,
        CASE WHEN n >= {t} THEN 'all-classes' ELSE 'top-level-only' END AS mode
      FROM numbered WHERE NOT warmed AND NOT warm AND (n = 1 OR n >= {t})"""
    return {
        "catalog_classes": _with(_CLASSES, _ENTRIES) + f"""
            SELECT jar_path, entry_idx, {_CLASS_OF_ENTRY} AS fqn FROM ent
            WHERE suffix(entry_name, '.class') AND NOT contains(entry_name, '$')""",
        "exact_probe": _with(_CLASSES, _ENTRIES) + """
            SELECT DISTINCT r.fqn, e.jar_path FROM ent e JOIN (SELECT DISTINCT fqn FROM cls) r
            ON e.entry_name = replace(r.fqn, '.', '/') || '.class'""",
        "suffix_probe": _with(_CLASSES, _ENTRIES, _SUFFIX) + " SELECT simple_name, jar_path, fqn FROM sfx",
        "sources_jar_path": _with(_CLASSES, _PATHS) + """
            SELECT doc_id, doc_id % 6 NOT IN (1, 2) AS is_artifact,
              CASE WHEN doc_id % 6 IN (3, 4, 5) THEN path[:-5] || '-sources.jar' END AS sources_path
            FROM paths""",
        "sources_sibling": _with(_CLASSES, _KNOWN) + """
            SELECT DISTINCT jar_path,
              CASE WHEN version::DOUBLE % 3 <> 0 THEN jar_path[:-5] || '-sources.jar' END AS sources_path
            FROM cls""",
        "source_entry_paths": _with(_CLASSES) + """
            SELECT doc_id, 'org/' || lang || '/core/' || simple_name || '.java' AS entry_name,
              'org/' || lang || '/core/' || simple_name || '.class' AS class_entry, fqn AS class_name,
              doc_id % 4 NOT IN (1, 2) AS is_class_source FROM cls""",
        "source_point_read": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT d.fqn, d.jar_path, split_part(d.jar_path, '/', -2) AS version, sha256(s.content) AS content_hash
            FROM dec d LEFT JOIN srcs s USING (fqn, jar_path)""",
        "bulk_sources_keep_first": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT jar_path, fqn, doc_id AS entry_idx, sha256(content) AS content_hash FROM srcs""",
        "normalize_query": _with(_CLASSES, _QUERIES) + """
            SELECT doc_id, class_name, contains(class_name, '.') AS is_qualified FROM req""",
        "version_from_path": _with(_CLASSES, _PATHS) + """
            SELECT doc_id, CASE WHEN doc_id % 6 IN (3, 4) THEN NULL ELSE version END AS version FROM paths""",
        "version_filter": _with(_CLASSES) + "SELECT DISTINCT fqn, jar_path FROM cls WHERE version = '10.0'",
        "content_hash": _with(_CLASSES) + "SELECT doc_id, sha256(content) AS content_hash FROM cls",
        "extract_class_name": _with(_CLASSES) + """
            SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN NULL ELSE
              CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'org.' || lang || '.' END
              || CASE doc_id % 8 WHEN 3 THEN simple_name || '(int' WHEN 4 THEN 'of' ELSE simple_name END
              END AS class_name FROM cls""",
        "split_decompiled": _with(_CLASSES, _OUTPUT) + """
            SELECT doc_id, 0::BIGINT AS position, fqn AS class_name,
              sha256(regexp_replace(banner || content, '\\s+$', '')) AS content_hash FROM outp
            UNION ALL
            SELECT doc_id, 1, 'org.' || lang || '.alt.I', sha256(banner || second) FROM outp""",
        "collapse_whitespace": _with(_CLASSES) + r"""
            SELECT doc_id, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS collapsed_hash FROM cls""",
        "decode_text": _with(_CLASSES, _OUTPUT) + """
            SELECT doc_id, sha256('Processing' || chr(10) || banner || content || banner || '// nothing here' || chr(10)
              || banner || second || chr(10)) AS text_hash FROM outp""",
        "class_structures": _with(_CLASSES, _JAVA) + """
            SELECT doc_id, 'org.' || lang || '.core' AS package, '*,org.' || lang || '.util.' || source AS imports,
              '@Tag(names = {"{", ";"})' || chr(10) || 'public  final class ' || simple_name
                || '<T extends Base<T>> extends Base<T> implements A,' || chr(10) || ' B' AS class_declaration,
              '/** ' || source || ' */' AS class_comment,
              len(lines)::BIGINT AS n_fields, 2::BIGINT AS n_methods,
              sha256('/** ' || source || ' */' || chr(10)
                || array_to_string(list_transform(lines, lambda x: rtrim('// ' || x)), chr(10)) || chr(10)
                || '/* a */' || chr(10) || '/* total */' || chr(10) || '// }') AS comments_hash
            FROM java""",
        "structure_members": _with(_CLASSES, _JAVA) + """
            , lined AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM java)
            SELECT doc_id, 'field' AS kind, i::BIGINT AS position,
              'private String f' || i || ' = "' || i || '; {", g' || i || '[] = {};' AS declaration,
              rtrim('// ' || line) AS comment FROM lined
            UNION ALL
            SELECT doc_id, 'method', 0,
              '@Override' || chr(10) || '    public<K> int size(List<K> x, int[] y) throws E', NULL FROM java
            UNION ALL
            SELECT doc_id, 'method', 1, simple_name || '()', NULL FROM java""",
        "member_search": _with(_CLASSES, _JAVA) + """
            SELECT doc_id, len(lines) > 3 AS has_field, simple_name = 'C3' AS has_method FROM java""",
        "registry_build": _with(_CLASSES) + "SELECT fqn, jar_path, min(doc_id) AS seq FROM cls GROUP BY ALL",
        "registry_counts": _with(_CLASSES) + """
            SELECT fqn, count(DISTINCT jar_path) AS artifacts, arg_min(jar_path, doc_id) AS first_jar
            FROM cls GROUP BY fqn""",
        "registry_append_new": _with(_CLASSES, _KNOWN) + """
            SELECT fqn, jar_path, min(doc_id) AS seq FROM cls
            WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.fqn = cls.fqn AND k.jar_path = cls.jar_path)
            GROUP BY ALL""",
        "registry_store": _with(_CLASSES, _KNOWN) + """
            SELECT DISTINCT fqn, jar_path, CASE WHEN EXISTS (
              SELECT 1 FROM known k WHERE k.fqn = cls.fqn AND k.jar_path = cls.jar_path) THEN 1 ELSE 2 END::BIGINT AS seq
            FROM cls""",
        "registry_lookup": _with(_CLASSES, _QUERIES) + """
            SELECT fqn, jar_path, min(doc_id) AS seq FROM cls WHERE fqn IN (SELECT class_name FROM req) GROUP BY ALL""",
        "registry_validated": _with(_CLASSES, _ENTRIES, _KNOWN) + """
            SELECT DISTINCT fqn, jar_path FROM cls WHERE jar_path IN (SELECT jar_path FROM known)
              AND EXISTS (SELECT 1 FROM ent e WHERE e.jar_path = cls.jar_path
                AND e.entry_name = replace(cls.fqn, '.', '/') || '.class')""",
        "uncataloged_artifacts": _with(_CLASSES, _KNOWN) + """
            SELECT DISTINCT jar_path FROM cls WHERE jar_path NOT IN (SELECT jar_path FROM known)""",
        "index_summary": _with(_CLASSES, _ENTRIES, _KNOWN) + """
            , fresh AS (SELECT * FROM ent WHERE jar_path NOT IN (SELECT jar_path FROM known)),
            status AS (SELECT jar_path, bool_or(suffix(entry_name, '.class')) AS ok FROM fresh GROUP BY jar_path)
            SELECT (SELECT count(DISTINCT jar_path) FROM cls) AS scanned_jars,
              (SELECT count(*) FROM status WHERE ok) AS cataloged_jars_new,
              (SELECT count(*) FROM status WHERE NOT ok) AS failed_jars,
              (SELECT count(*) FROM fresh WHERE suffix(entry_name, '.class') AND NOT contains(entry_name, '$'))
                AS indexed_classes""",
        "search_scopes": _with(_CLASSES) + """
            , cand AS (
              SELECT DISTINCT fqn, unnest([0, 1]) AS position,
                unnest(['org/' || lang || '/core', 'org/' || lang]) AS scope FROM cls),
            hit AS (SELECT * FROM cand WHERE EXISTS (
              SELECT 1 FROM cls WHERE starts_with(cls.jar_path, cand.scope || '/')))
            SELECT fqn, row_number() OVER (PARTITION BY fqn ORDER BY position) - 1 AS tier, scope FROM hit
            UNION ALL SELECT DISTINCT simple_name, 0, '' FROM cls
            UNION ALL SELECT DISTINCT fqn, 0, '' FROM cls WHERE fqn NOT IN (SELECT fqn FROM hit)""",
        "tiered_scan": _with(_CLASSES) + """
            , tiered AS (SELECT DISTINCT fqn, jar_path,
              CASE WHEN starts_with(jar_path, 'org/' || lang || '/core/') THEN 0
                WHEN starts_with(jar_path, 'org/' || lang || '/') THEN 1 ELSE 2 END::BIGINT AS tier FROM cls)
            SELECT fqn, jar_path, tier FROM tiered
            QUALIFY tier = min(tier) OVER (PARTITION BY fqn)""",
        "find_fqn_versions": _with(_CLASSES, _QUERIES, _CACHE) + "SELECT * FROM found",
        "find_simple_best": _with(_CLASSES, _ENTRIES, _SUFFIX) + """
            SELECT simple_name, fqn, jar_path, split_part(jar_path, '/', -2) AS version
            FROM per_jar JOIN best USING (simple_name, fqn)""",
        "find_batch": _with(_CLASSES, _ENTRIES.replace("ent AS", "entries AS", 1), _LIVE, _ENT_IS_LIVE, _SUFFIX, _QUERIES, _KNOWN, _CACHE, _BATCH) + """
            SELECT q.name, q.wanted, coalesce(n, 0) AS versions, fqn, version, jar_path, content_hash, cache_hit, source,
              lookup_source, position
            FROM asked q LEFT JOIN answers a ON a.name = q.name AND a.wanted IS NOT DISTINCT FROM q.wanted""",
        "archive_catalog": _with(_CLASSES, _ENTRIES) + f"""
            SELECT doc_id, {_CLASS_OF_ENTRY} AS fqn FROM ent
            WHERE suffix(entry_name, '.class') AND NOT contains(entry_name, '$')""",
        "archive_probe": _with(_CLASSES, _ENTRIES) + """
            SELECT doc_id, fqn FROM ent WHERE entry_name = replace(fqn, '.', '/') || '.class'""",
        "archive_sources": _with(_CLASSES) + """
            SELECT doc_id, fqn, sha256(text) AS content_hash, sha256(text) AS entry_hash
            FROM (SELECT doc_id, fqn, content || '// ' || chr(65533) || chr(10) AS text FROM cls)""",
        "artifact_changes_stream": _with(_CLASSES) + """
            SELECT doc_id, fqn, (CASE WHEN lang = 'fr' THEN 2 ELSE 1 END)::BIGINT AS binary_reports,
                1::BIGINT AS sources_reports
            FROM cls""",
        "ambiguity": _with(_CLASSES, _ENTRIES, _SUFFIX) + "SELECT simple_name, fqn, artifacts FROM best",
        "default_version": _with(_CLASSES) + """
            SELECT fqn, version, jar_path FROM (SELECT DISTINCT fqn, version, jar_path FROM cls)
            QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY version DESC, jar_path DESC) = 1""",
        "cache_upsert": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn || '::' || jar_path AS cache_key, 'sources-jar' AS source, sha256(content) AS content_hash
            FROM cache""",
        "cache_upsert_stream": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn || '::' || jar_path AS cache_key, 'sources-jar' AS source, sha256(content) AS content_hash
            FROM cache""",
        "cache_lookup": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn, jar_path, c.content IS NOT NULL AS cache_hit,
              CASE WHEN c.content IS NOT NULL THEN 'sources-jar' END AS source, sha256(c.content) AS content_hash
            FROM (SELECT fqn, jar_path FROM cls UNION SELECT fqn, jar_path || '.old' FROM cls)
            LEFT JOIN cache c USING (fqn, jar_path)""",
        "missing_sources": _with(_CLASSES, _KNOWN) + """
            , gaps AS (
              SELECT c.jar_path, count(DISTINCT c.fqn) FILTER (k.fqn IS NULL) AS missing, count(k.fqn) AS covered
              FROM cls c LEFT JOIN known k ON k.fqn = c.fqn AND k.jar_path = c.jar_path GROUP BY 1)
            SELECT jar_path, missing FROM gaps WHERE missing > 0 OR covered = 0""",
        "load_union": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT jar_path, fqn, CASE WHEN original IS NULL THEN 'decompiled' ELSE 'sources-jar' END AS source,
              sha256(coalesce(original, d.content)) AS content_hash
            FROM texts JOIN dec d USING (fqn, jar_path)""",
        "load_skip_flag": _with(_CLASSES, _KNOWN) + """
            SELECT DISTINCT jar_path, jar_path IN (SELECT jar_path FROM known) AS skipped FROM cls""",
        "load_summary": _with(_CLASSES, _KNOWN) + """
            SELECT count(DISTINCT jar_path) AS targets,
              count(DISTINCT jar_path) FILTER (version::DOUBLE % 4 <> 0) AS succeeded,
              count(DISTINCT jar_path) FILTER (version::DOUBLE % 4 = 0) AS failed,
              count(DISTINCT (jar_path, fqn)) FILTER (
                version::DOUBLE % 4 <> 0 AND jar_path NOT IN (SELECT jar_path FROM known)) AS classes_loaded
            FROM cls""",
        "hotspot_state": _with(_LOG) + "SELECT * FROM state",
        "hotspot_requests": _with(_LOG) + requests.format(t=2),
        "hotspot_requests_late": _with(_LOG) + requests.format(t=5),
        "hotspot_requests_stream": _with(_LOG) + requests.format(t=2),
        "hotspot_top10": _with(_LOG) + """
            SELECT jar_path, access_count, last_access, warmed FROM state
            ORDER BY access_count DESC, last_access DESC, jar_path LIMIT 10""",
        "hotspot_top_unwarmed": _with(_LOG) + """
            SELECT jar_path, access_count, last_access FROM state WHERE NOT warmed AND access_count > 0
            ORDER BY access_count DESC, last_access DESC, jar_path LIMIT 20""",
        "store_stats": _with(_CLASSES, _KNOWN, _LOG) + """
            SELECT (SELECT count(DISTINCT (fqn, jar_path)) FROM cls) AS source_entries,
              (SELECT count(DISTINCT fqn) FROM cls) AS indexed_classes,
              (SELECT count(DISTINCT jar_path) FROM cls) AS cataloged_jars,
              (SELECT count(DISTINCT jar_path) FROM known) AS loaded_jars,
              (SELECT count(*) FROM state) AS hotspot_jars,
              (SELECT count(*) FROM state WHERE warmed) AS warmed_jars""",
        "mtime_changes": _with(_MTIME) + """
            SELECT n.jar_path, n.mtime_ns FROM new_t n LEFT JOIN old_t o USING (jar_path)
            WHERE o.mtime_ns IS NULL OR o.mtime_ns < n.mtime_ns""",
        "mtime_snapshot": _with(_MTIME) + """
            SELECT n.jar_path, n.mtime_ns FROM new_t n LEFT JOIN old_t o USING (jar_path)
            WHERE o.mtime_ns IS DISTINCT FROM n.mtime_ns""",
        "warmup_queue_order": """
            WITH tasks AS (SELECT 'user/' || user_id::VARCHAR || '.jar' AS jar_path, event_id AS seq,
              CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END::BIGINT AS priority,
              CASE event_type WHEN 'purchase' THEN 'all-classes' ELSE 'top-level-only' END AS mode FROM events)
            SELECT jar_path, priority, seq, mode FROM tasks
            QUALIFY row_number() OVER (PARTITION BY jar_path ORDER BY priority DESC, seq) = 1
            ORDER BY priority DESC, seq""",
        "warmup_targets_group": _with(_CLASSES) + """
            SELECT DISTINCT jar_path FROM cls WHERE starts_with(jar_path, 'org/en/') ORDER BY jar_path""",
        "warmup_targets_limit": _with(_CLASSES) + """
            SELECT DISTINCT jar_path FROM cls WHERE starts_with(jar_path, 'org/de/') ORDER BY jar_path LIMIT 15""",
        "warmup_exclusions": _with(_CLASSES, _ENTRIES) + f"""
            , found AS (SELECT DISTINCT jar_path, {_CLASS_OF_ENTRY} AS fqn FROM ent WHERE suffix(entry_name, '.class'))
            SELECT jar_path, fqn FROM found
            WHERE NOT contains(fqn, '$') AND NOT suffix(fqn, 'package-info') AND NOT suffix(fqn, 'module-info')
              AND fqn NOT IN (SELECT fqn FROM cls WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
        "find_json": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn, to_json({'version': version, 'jar_path': jar_path, 'content_hash': content_hash,
              'cache_hit': cache_hit, 'source': source, 'lookup_source': lookup_source})::VARCHAR AS json FROM found""",
        "find_text": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn, '- version: Some("' || version || '"), source: ' || source || ', lookup_source: registry, cache_hit: '
              || CASE WHEN cache_hit THEN 'true' ELSE 'false' END || ', jar: ' || jar_path AS line FROM found""",
        "structure_sources": _with(_CLASSES, _QUERIES, _CACHE) + """
            SELECT fqn, jar_path, source AS structure_source,
              sha256(coalesce(original, content)) AS content_hash FROM texts""",
    }
