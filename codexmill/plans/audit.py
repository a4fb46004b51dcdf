"""Registered queries: the audit of norms by recomputation. Lengths of texts and lines stand for what the tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions.text import STRUCTURAL
from codexmill.operators import audit
from codexmill.plans.catalogue import _t
from codexmill.registry import query
from codexmill.sources import stream

#: Classes of a line by its length modulo 9; types of a block and roles by the length of its text modulo 6 and 3 (of these queries alone).
_CLASSES = ("titulo_num", "articulo", "capitulo_num", "seccion", "anexo_num", "libro_num")
_TYPES = ("precepto", "encabezado", "nota_inicial", "firma", "preambulo", "otro")
_ROLES = ("annex", "structural_heading", "precept")
_DAY = "2020-01-01"


def _date(i: str, divide: str) -> str:
    step = f"(CASE WHEN n % 5 = 0 AND {i} = 3 THEN 1 ELSE {i} END)"
    return f"concat('20', lpad(CAST((n {divide} 4 + {step} * 3) % 20 AS VARCHAR(9)), 2, '0'), '-01-01')"


def _shared(divide: str) -> str:
    """Columns that both dialects can say alike, over t (the text) and n (its length)."""
    cases = lambda names, m: "CASE n % " + str(m) + "".join(f" WHEN {k} THEN '{name}'" for k, name in enumerate(names)) + " END"
    return f"""document_id, block_id, {cases(_TYPES, 6)} AS block_type, {cases(_ROLES, 3)} AS semantic_role, n % 2 = 0 AS is_annex,
  CASE WHEN n % 12 = 0 THEN 'other' WHEN n % 5 > 0 THEN concat(document_id, '__', block_id) END AS parent_id, concat('u/', document_id) AS html_url,
  CASE WHEN n % 14 = 0 THEN 'u' ELSE concat('u/', document_id, '#', block_id) END AS source_url, n % 7 > 1 AS indexable,
  CASE WHEN n % 13 > 0 THEN {_date("(1 + n % 3)", divide)} END AS index_date, {_date("(1 + n % 2)", divide)} AS latest_date, concat('N', CAST(1 + n % 2 AS VARCHAR(9))) AS latest_norm,
  CASE WHEN n % 6 = 0 THEN '2030-01-01' ELSE '2000-01-01' END AS validity_date, CASE WHEN n % 4 = 0 THEN 'B' END AS book, CASE WHEN n % 12 = 0 THEN 'A' END AS annex,
  CASE WHEN n % 8 = 0 THEN concat(t, ' Téngase en cuenta') WHEN n % 9 = 0 THEN concat('<b>', t) ELSE t END AS body, n % 10 > 0 AS current, t, n, place"""


def _blocks(spark, d):
    docs = _t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("document_id"), F.col("doc_id").cast("string").alias("block_id"), F.col("doc_id").alias("place"), F.coalesce("text", F.lit("")).alias("t"))
    b = spark.sql(f"SELECT {_shared('div')} FROM {{a}}", a=docs.withColumn("n", F.length("t")))
    css = "CASE length(p) % 9" + "".join(f" WHEN {k} THEN '{c}'" for k, c in enumerate(_CLASSES)) + " ELSE 'parrafo' END"
    versions = f"transform(filter(array(1, 2, 3), i -> i <= n % 4), i -> struct({_date('i', 'div')} AS publication_date, concat('N', CAST(i AS VARCHAR(9))) AS source_norm_id, i = 1 + n % 2 AS is_latest, CASE WHEN n % 11 = 0 THEN 'x' END AS text))"
    latest = f"""CASE WHEN current THEN struct(latest_date AS publication_date, latest_norm AS source_norm_id, validity_date, body AS text,
      transform(split(t, '\\n'), p -> struct({css} AS class, p AS text)) AS paragraphs, array(struct(substr(t, 5, 20) AS text), struct(concat('zz', substr(t, 1, 5)) AS text)) AS modification_notes) END"""
    none = "CAST(NULL AS STRING)"
    return b.selectExpr(
        "document_id", "block_id", "place AS order", "block_type", "semantic_role", "is_annex", "parent_id", "html_url", "source_url", "indexable", "index_date", f"{versions} AS versions", f"{latest} AS latest",
        f"named_struct('book', book, 'title', {none}, 'chapter', {none}, 'section', {none}, 'subsection', {none}, 'annex', annex) AS hierarchy",
    )


_LIST = ", ".join(f"'{c}'" for c in STRUCTURAL)
_CSS = "CASE length(p) % 9" + "".join(f" WHEN {k} THEN '{c}'" for k, c in enumerate(_CLASSES)) + " ELSE 'parrafo' END"
_BASE = f"""a AS (SELECT coalesce(source, 'none') AS document_id, doc_id::VARCHAR AS block_id, doc_id AS place, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
b AS (SELECT {_shared("//")} FROM a),
v AS (SELECT place, i, {_date("i", "//")} AS published, i = 1 + n % 2 AS is_latest FROM b, (VALUES (1), (2), (3)) AS k(i) WHERE i <= n % 4),
vs AS (SELECT place, count(*) AS n_versions, count(*) FILTER (is_latest) AS n_latest, count(*) FILTER (published = index_date) AS hits, max(published) AS newest, min(i) FILTER (published = index_date) AS chosen
  FROM v JOIN b USING (place) GROUP BY place),
l AS (SELECT place, block_type, current, unnest(string_split(t, chr(10))) AS p, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM b),
lc AS (SELECT *, {_CSS} AS css FROM l),
h AS (SELECT place, bool_or(css NOT IN ({_LIST})) AS any_body FROM lc GROUP BY place),
x AS (SELECT b.*, coalesce(n_versions, 0) AS n_versions, n_latest, chosen, CASE WHEN index_date IS NULL THEN 'missing_index_date' WHEN hits = 0 THEN 'unresolved' WHEN hits > 1 THEN 'ambiguous' WHEN index_date <> newest THEN 'index_not_max' ELSE 'resolved' END AS status,
  current AND any_body AS has_body, current AND any_body AND block_type NOT IN ('firma', 'nota_inicial') AND body <> '' AS expected,
  CASE WHEN current THEN body END AS txt FROM b JOIN h USING (place) LEFT JOIN vs USING (place)),
notes AS (SELECT document_id, block_id, txt, regexp_replace(unnest([substr(t, 5, 20), 'zz' || substr(t, 1, 5)]), '^\\s+|\\s+$', '', 'g') AS note FROM x WHERE current)"""
_R, _A, _M = "'Revisar antes de embeddings'", "'Aceptable MVP'", "'Mejora posterior'"


def _found(check: str, severity: str, kind: str, message: str, when: str, evidence: str = "NULL", table: str = "x") -> str:
    return f"SELECT '{check}' AS check_name, '{severity}' AS severity, {kind} AS classification, document_id, block_id AS ref, {message} AS message, {evidence}::VARCHAR AS evidence FROM {table} WHERE {when}"


@query(f"WITH {_BASE} " + " UNION ALL ".join([
    _found("block.temporal_quarantine", "ERROR", _R, "'no current version by the index: ' || status", "n_versions > 0 AND status <> 'resolved'", "status"),
    _found("block.temporal_inconsistent", "ERROR", _R, "'not resolved, yet not held back'", "n_versions > 0 AND status <> 'resolved' AND (current OR indexable)"),
    _found("block.temporal_mismatch", "ERROR", _R, "'the stored version is not the current one by the index'", "n_versions > 0 AND status = 'resolved' AND indexable AND (NOT current OR latest_date <> index_date OR latest_norm <> 'N' || chosen)", "CASE WHEN current THEN latest_date ELSE 'None' END || ' != ' || index_date"),
    _found("block.future_effective", "WARN", _A, "'takes effect on ' || validity_date", f"n_versions > 0 AND status = 'resolved' AND current AND validity_date > '{_DAY}'"),
    _found("block.type", "WARN", _R, "'unknown block_type: ' || block_type", "block_type = 'otro'"),
    _found("block.parent_id", "ERROR", _R, "'parent_id is not document and block joined by two underscores'", "parent_id = 'other'"),
    _found("block.is_latest", "ERROR", _R, "'versions marked as latest: ' || n_latest", "n_versions > 0 AND n_latest <> 1"),
    _found("block.versions_metadata", "ERROR", _M, "'versions hold more than metadata'", "n_versions > 0 AND n % 11 = 0"),
    _found("block.indexable", "WARN", _A, "'indexable is ' || indexable || ', the rule says ' || expected", "indexable <> expected"),
    _found("block.heading_body_not_indexed", "ERROR", _R, "'a heading with a body is not indexed'", "block_type = 'encabezado' AND has_body AND NOT indexable"),
    _found("block.structural_indexed", "ERROR", _R, "'a mere label is indexed'", "block_type = 'encabezado' AND NOT has_body AND indexable"),
    _found("block.source_url", "ERROR", _R, "'source_url is not html_url and block joined by #'", "source_url = 'u'"),
    _found("block.text_tags", "ERROR", _R, "'the text holds tags'", "regexp_matches(txt, '</?[a-zA-Z][^<>]*>')"),
    _found("block.note_leak", "ERROR", _R, "'a modification note stands in the text'", "note <> '' AND contains(txt, note)", "left(note, 80)", "notes"),
    _found("block.editorial_leak", "ERROR", _R, "'an editorial formula stands in the text'", r"regexp_matches(txt, 't[eé]ngase en cuenta|redacci[oó]n(es)?\s+anterior(es)?\s*:', 'i')", r"regexp_extract(txt, 't[eé]ngase en cuenta|redacci[oó]n(es)?\s+anterior(es)?\s*:', 0, 'i')"),
    _found("block.semantic_role", "WARN", _M, "'an annex has the role ' || semantic_role", "block_type = 'encabezado' AND is_annex AND has_body AND semantic_role <> 'annex'"),
    _found("block.semantic_role", "WARN", _M, "'a heading with a body has the role structural_heading'", "block_type = 'encabezado' AND has_body AND semantic_role = 'structural_heading'"),
    _found("block.annex_dragged", "WARN", _R, "'an annex beside levels of the body'", "annex IS NOT NULL AND book IS NOT NULL"),
    _found("block.annex_local_context_missing", "WARN", _M, "'an annex without its level'", "is_annex AND semantic_role = 'annex' AND annex IS NULL"),
]))
def block_audit(spark, d):
    """Temporal, block and semantic rules over blocks whose texts and lines are those of documents."""
    return audit.audit_blocks(_blocks(spark, d), _DAY)


@query(f"""WITH {_BASE}, g AS (SELECT place, css, arg_max(p, i) AS p FROM lc WHERE block_type = 'encabezado' AND current AND css IN ({", ".join(f"'{c}'" for c in audit.LEVELS.values())}) GROUP BY ALL),
e AS (SELECT place, arg_min(css, k) AS css, arg_min(p, k) AS p FROM g JOIN (VALUES {", ".join(f"({k}, '{c}')" for k, c in enumerate(audit.LEVELS.values()))}) AS o(k, css) USING (css) GROUP BY place),
s AS (SELECT x.place, document_id, block_id, x.book, x.annex, css, p FROM x LEFT JOIN e USING (place)),
{", ".join(f"r{k} AS (SELECT place, '{level}' AS level, last_value(CASE WHEN css = '{css}' THEN p END IGNORE NULLS) OVER (PARTITION BY document_id, resets ORDER BY place) AS anew FROM (SELECT *, count(*) FILTER (css IN ({', '.join(repr(c) for c in ([*list(audit.LEVELS.values())[:k], 'anexo_num'] if level != 'annex' else list(audit.LEVELS.values())[:-1]))})) OVER (PARTITION BY document_id ORDER BY place) AS resets FROM s))" for k, (level, css) in enumerate(audit.LEVELS.items()))},
u AS (SELECT s.document_id, s.block_id, level, anew, CASE level WHEN 'book' THEN book WHEN 'annex' THEN annex END AS stored FROM s JOIN ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(audit.LEVELS)))}) USING (place))
SELECT 'block.hierarchy_stale' AS check_name, 'WARN' AS severity, {_R} AS classification, document_id, block_id AS ref, level || ' is ' || coalesce(stored, 'null') AS message, anew AS evidence FROM u WHERE stored IS DISTINCT FROM anew""")
def hierarchy_audit(spark, d):
    """Stored levels against the heading state of each source's documents in order."""
    return audit.audit_blocks(_blocks(spark, d), _DAY, audit.HIERARCHY_RULES)


_META = "CASE WHEN n % 6 = 0 THEN concat('x', id) WHEN n % 7 = 0 THEN '' ELSE id END AS identifier, left(t, CAST(n % 11 AS INT)) AS publication_date, CASE WHEN n % 3 > 0 THEN '2020-01-01' END AS document_date, concat('2020-01-0', CAST(n % 12 AS VARCHAR(9))) AS effective_date, CASE WHEN n % 5 = 0 THEN '2020-01-01' WHEN n % 5 = 1 THEN '2020-01-01T00:00:00Z' END AS last_update_datetime"


@query(f"""WITH a AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(source, '') AS source FROM documents),
b AS (SELECT id, n, CASE WHEN n % 4 = 0 THEN 'v1' WHEN n % 9 > 0 THEN '{audit.SCHEMA_VERSION}' END AS version, {_META}, CASE n % 5 WHEN 0 THEN '/' || source WHEN 1 THEN 'file:' || source WHEN 2 THEN source END AS manifest FROM a),
f AS (SELECT 'doc.schema' AS check_name, 'ERROR' AS severity, id, NULL AS ref, 'schema_version is ' || coalesce(version, 'null') AS message FROM b WHERE version IS DISTINCT FROM '{audit.SCHEMA_VERSION}'
UNION ALL SELECT 'doc.keys', 'ERROR', id, NULL, 'top-level key is missing: ' || k FROM b, (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(audit.DOCUMENT_KEYS))}) AS q(i, k) WHERE n % 7 = i
UNION ALL SELECT 'doc.identity', 'ERROR', id, NULL, 'metadata.identifier is ' || identifier FROM b WHERE identifier <> '' AND identifier <> id
UNION ALL SELECT 'doc.date', 'WARN', id, name, 'not an ISO date: ' || value FROM (SELECT id, unnest(['publication_date', 'document_date', 'effective_date']) AS name, unnest([publication_date, document_date, effective_date]) AS value FROM b) WHERE value <> '' AND NOT regexp_matches(value, '{audit.DATE}')
UNION ALL SELECT 'doc.date', 'WARN', id, 'last_update_datetime', 'not an ISO datetime: ' || last_update_datetime FROM b WHERE NOT regexp_matches(last_update_datetime, '{audit.DATETIME}')
UNION ALL SELECT 'doc.manifest_ref', 'ERROR', id, NULL, 'manifest_ref is no stable relative path: ' || manifest FROM b WHERE manifest LIKE '/%' OR contains(manifest, ':'))
SELECT check_name, severity, {_R} AS classification, id AS document_id, ref::VARCHAR AS ref, message, NULL::VARCHAR AS evidence FROM f""")
def document_audit(spark, d):
    """Contract, keys, identity, dates and manifest of documents as norms."""
    a = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce("source", F.lit("")).alias("source"))
    keys = ", ".join(f"CASE WHEN n % 7 <> {i} THEN '{k}' END" for i, k in enumerate(audit.DOCUMENT_KEYS))
    rows = a.selectExpr(
        "id AS document_id", f"CASE WHEN n % 4 = 0 THEN 'v1' WHEN n % 9 > 0 THEN '{audit.SCHEMA_VERSION}' END AS schema_version", f"array_compact(array({keys})) AS keys", f"struct({_META}) AS metadata",
        "CASE n % 5 WHEN 0 THEN concat('/', source) WHEN 1 THEN concat('file:', source) WHEN 2 THEN source END AS manifest_ref",
    )
    return audit.audit_documents(rows)


#: A norm for each document: its sentences are paragraphs, quotes, notes or table rows by their length and place modulo 7.
_RAW = r"""a AS (SELECT doc_id::VARCHAR AS id, length(coalesce(text, '')) AS n, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.\n]'), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9,]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
p AS (SELECT id, n, i, lines[i] AS line, (length(lines[i]) + i) % 7 AS kind FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM a)),
k AS (SELECT id, list(CASE WHEN kind = 2 THEN line || ' | ' || length(line) ELSE line END ORDER BY i) FILTER (kind > 1) AS kept, list(line ORDER BY i) FILTER (kind > 2) AS plain, count(*) FILTER (kind = 1) AS n_notes, count(*) FILTER (kind = 0) AS n_dropped,
  arg_min(line, i) FILTER (kind = 0) AS sample, coalesce(bool_or(kind = 0 AND length(line) % 2 = 0), false) AS article FROM p GROUP BY id),
s AS (SELECT a.id, n, coalesce(kept, []) AS kept, coalesce(plain, []) AS plain, coalesce(n_notes, 0) AS n_notes, coalesce(n_dropped, 0) AS n_dropped, sample, coalesce(article, false) AS article, n % 17 = 0 AS gone FROM a LEFT JOIN k USING (id)
  WHERE n % 10 > 0 AND (n % 17 = 0 OR (n % 11 > 0 AND n % 13 > 0))),
t AS (SELECT *, CASE n % 6 WHEN 0 THEN kept[:len(kept) - 1] WHEN 1 THEN list_append(kept, 'extra') WHEN 2 THEN list_concat(list_transform(kept[1:1], lambda x: x || '!'), kept[2:]) ELSE kept END AS held, CASE WHEN n % 4 = 0 THEN array_to_string(plain, ' ') ELSE array_to_string(kept, ' ') END AS body FROM s),
u AS (SELECT *, list_position(list_transform(range(1, greatest(len(kept), len(held)) + 1), lambda i: kept[i] IS DISTINCT FROM held[i]), true) - 1 AS first, n_dropped / greatest(len(kept) + n_notes + n_dropped, 1) AS share FROM t),
c AS (SELECT u.id, count(*) AS n_cells, array_to_string((list(line ORDER BY i))[:3], ' | ') AS cells FROM p JOIN u USING (id) WHERE kind = 2 AND NOT gone AND length(line) >= 4 AND regexp_matches(line, '[A-Za-z]') AND NOT contains(body, line) GROUP BY u.id)"""


def _editorial(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("t"))
    lines = F.filter(F.transform(F.split("t", r"[.\n]"), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9,]+", " "))), lambda x: x != "")
    rows = docs.select("document_id", F.length("t").alias("n"), lines.alias("lines")).withColumn("kinds", F.transform("lines", lambda x, i: (F.length(x) + i + 1) % 7))
    quote = lambda x: F.concat(F.lit('<blockquote><p class="'), F.when(F.length(x) % 2 == 0, "articulo").otherwise("cita"), F.lit('">'), x, F.lit("</p></blockquote>"))
    table = lambda x: F.concat(F.lit("<table><tr><td>"), x, F.lit("</td><td>"), F.length(x).cast("string"), F.lit("</td></tr></table>"))
    one = lambda x, k: F.when(k == 0, quote(x)).when(k == 1, F.concat(F.lit('<p class="nota_pie">'), x, F.lit("</p>"))).when(k == 2, table(x)).otherwise(F.concat(F.lit('<p class="parrafo">'), x, F.lit("</p>")))
    body = F.array_join(F.zip_with("lines", "kinds", one), "\n")
    version = lambda norm, day, text: F.concat(F.lit(f'<version id_norma="{norm}" fecha_publicacion="{day}">'), text, F.lit("</version>"))
    xml = F.concat(F.lit('<response><status><code>200</code></status><data><texto><bloque id="b" tipo="precepto">'), version("M", "20190101", F.lit("<p>old</p>")), version("N", "20200101", body), F.lit("</bloque></texto></data></response>"))
    raw = stream.stream_norms(rows.select(F.col("document_id").alias("file"), xml.cast("binary").alias("content"))).withColumnRenamed("file", "document_id")
    pairs = F.zip_with("lines", "kinds", lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    some = lambda least: F.transform(F.filter(pairs, lambda p: p["k"] > least), lambda p: F.when(p["k"] == 2, F.concat(p["x"], F.lit(" | "), F.length(p["x"]).cast("string"))).otherwise(p["x"]))
    made = rows.select("document_id", "n", some(1).alias("kept"), some(2).alias("plain"))
    m = F.col("n") % 6
    held = F.when(m == 0, F.slice("kept", F.lit(1), F.greatest(F.size("kept") - 1, F.lit(0)))).when(m == 1, F.array_append("kept", "extra")).when(m == 2, F.transform("kept", lambda x, i: F.when(i == 0, F.concat(x, F.lit("!"))).otherwise(x))).otherwise(F.col("kept"))
    norm, text = F.when(F.col("n") % 11 > 0, "N").otherwise("M"), F.when(F.col("n") % 4 == 0, F.array_join("plain", " ")).otherwise(F.array_join("kept", " "))
    latest = F.struct(F.lit("2020-01-01").alias("publication_date"), norm.alias("source_norm_id"), text.alias("text"), F.transform(held, lambda x: F.struct(F.lit("parrafo").alias("class"), x.alias("text"))).alias("paragraphs"))
    return raw, made.select(
        "document_id", F.when(F.col("n") % 17 == 0, "x").otherwise("b").alias("block_id"), F.when(F.col("n") % 13 > 0, "2020-01-01").otherwise("2018-01-01").alias("index_date"), F.when(F.col("n") % 10 > 0, latest).alias("latest"),
    )


_E = "id AS document_id, CASE WHEN gone THEN 'x' ELSE 'b' END AS ref"


@query(f"""WITH {_RAW}
SELECT 'block.editorial_invariant' AS check_name, 'ERROR' AS severity, {_R} AS classification, {_E}, 'the block is not in the raw norm' AS message, NULL::VARCHAR AS evidence FROM u WHERE gone
UNION ALL SELECT 'block.editorial_invariant', 'ERROR', {_R}, {_E}, CASE WHEN len(held) > len(kept) THEN 'leak' ELSE 'overdeletion' END || ': stored paragraphs are not those of the raw norm from place ' || first || ' on', coalesce(kept[first + 1], 'None') || ' | ' || coalesce(held[first + 1], 'None') FROM u WHERE NOT gone AND first >= 0
UNION ALL SELECT 'block.editorial_drop_structural', 'WARN', {_R}, {_E}, 'dropped from quotes: articulo', left(sample, 80) FROM u WHERE NOT gone AND article
UNION ALL SELECT 'block.editorial_drop_fraction', 'WARN', {_R}, {_E}, 'dropped ' || n_dropped || ' of ' || len(kept) + n_notes + n_dropped, left(sample, 80) FROM u WHERE NOT gone AND share > 0.5
UNION ALL SELECT 'block.table_cell_dropped', 'ERROR', {_R}, {_E}, n_cells || ' cells of tables are not in the text', left(cells, 160) FROM u JOIN c USING (id)""")
def editorial_audit(spark, d):
    """Stored paragraphs against those that a stream over the raw XML of each document gives anew."""
    return audit.editorial_findings(audit.editorial_state(*_editorial(spark, d)))


@query(f"""WITH {_RAW}, r AS (SELECT u.id, n_dropped, share, count(*) FILTER (length(line) % 2 = 0) AS articles, count(*) FILTER (length(line) % 2 = 1) AS quotes FROM u JOIN p ON p.id = u.id AND kind = 0 WHERE NOT gone GROUP BY ALL)
SELECT count(*) AS n_blocks, sum(n_dropped)::BIGINT AS n_dropped, count(*) FILTER (share > 0.5 OR articles > 0) AS n_anomalies, sum(articles)::BIGINT AS articles, sum(quotes)::BIGINT AS quotes FROM r""")
def editorial_drops(spark, d):
    """What the same reading drops, over all documents."""
    s = audit.drop_summary(audit.drop_records(audit.editorial_state(*_editorial(spark, d))))
    of = lambda c: F.get(F.transform(F.filter("dropped_classes", lambda x: x["class"] == c), lambda x: x["n"]), F.lit(0))
    return s.select("n_blocks", "n_dropped", "n_anomalies", of("articulo").alias("articles"), of("cita").alias("quotes"))
