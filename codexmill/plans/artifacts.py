"""Registered queries: blocks and their artefacts, relational and chunk checks, readiness, gates, fingerprints. Documents stand for blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import artifacts as A
from codexmill.operators import blocks, quality
from codexmill.plans.catalogue import _t
from codexmill.registry import query

_LABELS = "', '".join(T.STRUCTURAL)
_BLOCKS = """b AS (SELECT doc_id, 'd' || doc_id // 10 AS document_id, 'b' || doc_id % 10 AS block_id, (doc_id % 10)::INT AS "order", ['precepto', 'encabezado', 'preambulo', 'firma', 'encabezado'][doc_id % 5 + 1] AS block_type,
  CASE WHEN doc_id % 4 > 0 THEN 'Artículo ' || doc_id END AS block_title, coalesce(text, '') AS text, CASE WHEN doc_id % 9 = 0 THEN 'ambiguous' ELSE 'resolved' END AS temporal_status, doc_id % 17 = 0 AS raw_has_table, source, lang,
  list_filter([CASE doc_id % 7 WHEN 0 THEN {'class': 'titulo_num', 'text': 'TÍTULO I'} WHEN 1 THEN {'class': 'articulo', 'text': 'Artículo 1'} WHEN 2 THEN {'class': 'capitulo_tit', 'text': ' Reglas  comunes '} WHEN 3 THEN {'class': 'anexo', 'text': 'Anexo I'}
    WHEN 4 THEN {'class': 'anexo_num', 'text': 'ANEXO'} WHEN 5 THEN {'class': 'seccion', 'text': 'Sección 1'} END, CASE WHEN doc_id % 7 = 0 THEN {'class': 'titulo_tit', 'text': source} END,
    CASE WHEN doc_id % 13 = 0 THEN {'class': 'parrafo', 'text': '(Sin contenido)'} WHEN doc_id % 3 > 0 THEN {'class': 'parrafo', 'text': lang} END, CASE WHEN doc_id % 11 = 0 THEN {'class': 'cuerpo_tabla_izq', 'text': 'a | b'} END], lambda x: x IS NOT NULL) AS p FROM documents)"""


def _blocks(spark, d):
    i = F.col("doc_id")
    one = lambda css, text: F.struct(F.lit(css).alias("class"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    heads = [("titulo_num", "TÍTULO I"), ("articulo", "Artículo 1"), ("capitulo_tit", " Reglas  comunes "), ("anexo", "Anexo I"), ("anexo_num", "ANEXO"), ("seccion", "Sección 1")]
    head = F.when(F.lit(False), one("", ""))
    for k, pair in enumerate(heads):
        head = head.when(i % 7 == k, one(*pair))
    body = F.when(i % 13 == 0, one("parrafo", "(Sin contenido)")).when(i % 3 > 0, one("parrafo", F.col("lang")))
    p = F.filter(F.array(head, F.when(i % 7 == 0, one("titulo_tit", F.col("source"))), body, F.when(i % 11 == 0, one("cuerpo_tabla_izq", "a | b"))), lambda x: x.isNotNull())
    kinds = F.array(*map(F.lit, ("precepto", "encabezado", "preambulo", "firma", "encabezado")))
    return _t(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.floor(i / 10).cast("string")).alias("document_id"), F.concat(F.lit("b"), (i % 10).cast("string")).alias("block_id"), (i % 10).cast("int").alias("order"),
        F.get(kinds, (i % 5).cast("int")).alias("block_type"), F.when(i % 4 > 0, F.concat(F.lit("Artículo "), i.cast("string"))).alias("block_title"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(i % 9 == 0, "ambiguous").otherwise("resolved").alias("temporal_status"), (i % 17 == 0).alias("raw_has_table"), F.lit(False).alias("contains_image"), "source", "lang", p.alias("paragraphs"),
    )


_LEAD = f"""s AS (SELECT *, list_transform(p, lambda x: x.class NOT IN ('{_LABELS}')) AS plain FROM b),
l AS (SELECT *, CASE WHEN list_contains(plain, true) THEN p[1:list_position(plain, true) - 1] ELSE p END AS lead, list_contains(plain, true) AS body,
  len(list_filter(p, lambda x: x.class = 'cabeza_tabla' OR starts_with(x.class, 'cuerpo_tabla_'))) > 0 AS tabled, len(list_filter(p, lambda x: x.class = 'anexo_num')) > 0 AS numbered,
  len(list_filter(p, lambda x: x.class = 'anexo' AND starts_with(upper(trim(x.text)), 'ANEXO'))) > 0 AS single FROM s)"""
_FIRST = "list_filter(lead, lambda x: x.class = '{}')[1].text"
_TITLES = ", ".join(
    f"CASE WHEN {_FIRST.format(n)} IS NOT NULL THEN trim(regexp_replace(concat_ws('. ', nullif({_FIRST.format(n)}, ''), nullif({_FIRST.format(t)}, '')), '\\s+', ' ', 'g')) END, trim(regexp_replace({_FIRST.format(t)}, '\\s+', ' ', 'g'))" for n, t in A.PAIRS
)
_ROLE = """CASE block_type WHEN 'precepto' THEN 'precept' WHEN 'preambulo' THEN 'preamble' WHEN 'firma' THEN 'signature' WHEN 'encabezado' THEN CASE WHEN body AND (numbered OR single) THEN 'annex' WHEN body THEN 'content_heading' ELSE 'structural_heading' END ELSE block_type END"""


@query(f"""WITH {_BLOCKS}, {_LEAD}
SELECT doc_id, {_ROLE} AS semantic_role, body AS has_retrievable_body, numbered OR single AS is_annex, single AND NOT numbered AS annex_is_local, raw_has_table OR tabled AS contains_table, tabled AS table_text_available,
CASE WHEN p[1].class = 'articulo' THEN p[1].text WHEN block_type = 'encabezado' AND len(p) > 0 THEN coalesce({_TITLES}, {", ".join(_FIRST.format(x) for x in A.SINGLES)}) END AS full_title,
len(list_filter(p, lambda x: x.class NOT IN ('{_LABELS}', 'articulo'))) > 0 AND trim(regexp_replace(lower(trim(regexp_replace(array_to_string(list_transform(list_filter(p, lambda x: x.class NOT IN ('{_LABELS}', 'articulo')), lambda x: x.text), ' '), '\\s+', ' ', 'g'))), '[^0-9a-záéíóúñü ]', '', 'g')) = 'sin contenido' AS is_without_content FROM l""")
def block_semantics(spark, d):
    """Roles, titles and flags of blocks."""
    return A.with_semantics(_blocks(spark, d)).select("doc_id", "semantic_role", "has_retrievable_body", "is_annex", "annex_is_local", "contains_table", "table_text_available", "full_title", "is_without_content")


_DESCRIBED = f"""{_BLOCKS}, {_LEAD}, x AS (SELECT *, {_ROLE} AS semantic_role, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'Ley 1' END AS short_title, CASE WHEN doc_id % 8 > 0 THEN 'http://x/' || document_id END AS html_url FROM l),
y AS (SELECT *, body AND block_type <> 'firma' AND text <> '' AND temporal_status = 'resolved' AS indexable, CASE WHEN temporal_status <> 'resolved' THEN 'temporal_quarantine:' || temporal_status WHEN body AND block_type <> 'firma' AND text <> '' THEN NULL WHEN block_type = 'firma' THEN 'excluded_type:firma' WHEN NOT body THEN 'no_retrievable_body' END AS excluded_reason,
  coalesce(short_title, document_id) || CASE WHEN block_title IS NULL THEN '' ELSE ', ' || lower(block_title[1]) || block_title[2:] END AS citation_label, html_url || '#' || block_id AS source_url,
  CASE WHEN temporal_status = 'resolved' AND trim(text) <> '' THEN document_id || '__' || block_id END AS parent_id FROM x)"""


def _described(spark, d):
    i = F.col("doc_id")
    made = A.with_semantics(_blocks(spark, d)).withColumn("short_title", F.when(i % 6 > 0, "Ley 1")).withColumn("html_url", F.when(i % 8 > 0, F.concat(F.lit("http://x/"), "document_id")))
    return A.with_descriptors(made)


@query(f"""WITH {_DESCRIBED} SELECT document_id, block_id, "order", block_type, semantic_role, indexable, excluded_reason, citation_label, source_url, parent_id FROM y""")
def document_descriptors(spark, d):
    """The document artefact: indexability, reasons, citations, parents."""
    return A.document_rows(_described(spark, d)).select("document_id", "block_id", "order", "block_type", "semantic_role", "indexable", "excluded_reason", "citation_label", "source_url", "parent_id")


_VERSIONS = """v AS (SELECT document_id, block_id, k, CASE WHEN k = 2 THEN '2020-01-01' ELSE '2010-01-01' END AS published, 'n' || k AS norm_id, k = 2 AND temporal_status = 'resolved' AS is_current FROM b CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE doc_id % 10 <> 3)"""


def _versions(spark, d):
    b = _blocks(spark, d).where("doc_id % 10 <> 3").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return b.select("document_id", "block_id", F.when(F.col("k") == 2, "2020-01-01").otherwise("2010-01-01").alias("published"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("norm_id"), ((F.col("k") == 2) & (F.col("temporal_status") == "resolved")).alias("is_current"))


@query(f"""WITH {_DESCRIBED}, {_VERSIONS}, h AS (SELECT document_id, block_id, count(*) AS n, max(norm_id) FILTER (is_current) AS current_norm FROM v GROUP BY ALL)
SELECT y.document_id, y.block_id, semantic_role, temporal_status, coalesce(h.n, 0) AS n_versions, current_norm, CASE WHEN parent_id IS NOT NULL THEN sha256(text) END AS text_sha256 FROM y LEFT JOIN h USING (document_id, block_id)""")
def joined_artifacts(spark, d):
    """Descriptors with history and current text, from the three artefacts."""
    b = _described(spark, d)
    j = A.joined_norm(A.document_rows(b), A.history_rows(b, _versions(spark, d)), A.parent_rows(b))
    current = F.get(F.filter("versions", lambda v: v["is_current"]), F.lit(0))["norm_id"]
    return j.select("document_id", "block_id", "semantic_role", "temporal_status", F.size("versions").cast("long").alias("n_versions"), current.alias("current_norm"), F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {_BLOCKS}, i AS (SELECT document_id, block_id, "order" FROM b WHERE doc_id % 10 NOT IN (2, 5) UNION ALL SELECT DISTINCT document_id, 'extra', 10 FROM b), t AS (SELECT document_id, block_id, "order" AS o, temporal_status FROM b WHERE doc_id % 10 <> 7),
x AS (SELECT document_id, max("order") + 1 AS nx FROM i GROUP BY 1)
SELECT document_id, block_id, CASE WHEN i."order" IS NOT NULL THEN i."order" ELSE coalesce(nx, 0) + row_number() OVER (PARTITION BY document_id, i."order" IS NULL ORDER BY o) - 1 END AS "order", CASE WHEN t.o IS NULL THEN 'unresolved' ELSE temporal_status END AS temporal_status
FROM i FULL JOIN t USING (document_id, block_id) LEFT JOIN x USING (document_id)""")
def merged_index(spark, d):
    """The index's blocks in its order, the text's own after them."""
    b = _blocks(spark, d)
    index = b.where("doc_id % 10 not in (2, 5)").select("document_id", "block_id", "order").unionByName(b.select("document_id", F.lit("extra").alias("block_id"), F.lit(10).alias("order")).distinct())
    texts = b.where("doc_id % 10 <> 7").select("document_id", "block_id", F.col("order").alias("text_order"), "temporal_status")
    return A.merged_blocks(index, texts).select("document_id", "block_id", F.col("order").cast("long").alias("order"), "temporal_status")


_CHUNKS = """c AS (SELECT parent_id || '__c' || lpad(k::VARCHAR, 3, '0') AS chunk_id, document_id, CASE WHEN doc_id % 23 = 0 THEN 'lost' ELSE parent_id END AS parent_id, k AS place, CASE WHEN doc_id % 19 = 0 THEN 3 ELSE 2 END AS n_places,
  CASE WHEN doc_id % 29 = 0 THEN '~' || text ELSE CASE WHEN k = 1 THEN left(text, 40) ELSE text[41:] END END AS text, [lang] AS subject_codes FROM y CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE parent_id IS NOT NULL),
pa AS (SELECT CASE WHEN doc_id % 31 = 0 THEN parent_id || 'x' ELSE parent_id END AS parent_id, document_id, CASE WHEN doc_id % 31 = 0 THEN 'none' ELSE block_id END AS block_id, text, '2020-01-01' AS published, CASE WHEN doc_id % 7 = 0 THEN 'n1' ELSE 'n2' END AS norm_id FROM y WHERE parent_id IS NOT NULL),
dd AS (SELECT document_id, block_id, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE parent_id END AS parent_id FROM y WHERE doc_id % 41 <> 0)"""


def _artefacts(spark, d):
    b = _described(spark, d).withColumn("parent_id", F.when(A.has_current_text(), F.concat_ws("__", "document_id", "block_id")))
    i, k = F.col("doc_id"), F.col("place")
    whole = b.where("parent_id is not null")
    chunks = whole.withColumn("place", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat("parent_id", F.lit("__c"), F.lpad(k.cast("string"), 3, "0")).alias("chunk_id"), "document_id", F.when(i % 23 == 0, "lost").otherwise(F.col("parent_id")).alias("parent_id"), "place", F.when(i % 19 == 0, 3).otherwise(2).alias("n_places"),
        F.when(i % 29 == 0, F.concat(F.lit("~"), "text")).when(k == 1, F.substring("text", 1, 40)).otherwise(F.expr("substring(text, 41)")).alias("text"), F.array("lang").alias("subject_codes"),
    )
    odd = i % 31 == 0
    parents = whole.select(
        F.when(odd, F.concat("parent_id", F.lit("x"))).otherwise(F.col("parent_id")).alias("parent_id"), "document_id", F.when(odd, "none").otherwise(F.col("block_id")).alias("block_id"), "text", F.lit("2020-01-01").alias("published"), F.when(i % 7 == 0, "n1").otherwise("n2").alias("norm_id")
    )
    documents = b.where("doc_id % 41 <> 0").select("document_id", "block_id", F.when(i % 37 == 0, F.lit(None)).otherwise(F.col("parent_id")).alias("parent_id"), "indexable", "block_type")
    return documents, parents, chunks


@query(f"""WITH {_DESCRIBED}, {_VERSIONS}, {_CHUNKS}, su AS (SELECT DISTINCT document_id, lang AS code FROM b WHERE lang <> 'es'),
cu AS (SELECT document_id, block_id, published, norm_id FROM v WHERE is_current)
SELECT 'parent_block_missing' AS check_name, parent_id AS ref FROM pa WHERE (document_id, block_id) NOT IN (SELECT (document_id, block_id) FROM dd)
UNION ALL SELECT 'history_block_missing', block_id FROM (SELECT DISTINCT document_id, block_id FROM v) z WHERE (document_id, block_id) NOT IN (SELECT (document_id, block_id) FROM dd)
UNION ALL SELECT 'parent_id_dangling', block_id FROM dd WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT parent_id FROM pa)
UNION ALL SELECT 'chunk_parent_missing', chunk_id FROM c WHERE parent_id NOT IN (SELECT parent_id FROM pa)
UNION ALL SELECT DISTINCT 'subject_code_unknown', chunk_id FROM (SELECT chunk_id, document_id, unnest(subject_codes) AS code FROM c) z WHERE (document_id, code) NOT IN (SELECT (document_id, code) FROM su)
UNION ALL SELECT 'current_version_mismatch', pa.parent_id FROM pa JOIN cu USING (document_id, block_id) WHERE pa.published <> cu.published OR pa.norm_id <> cu.norm_id
UNION ALL SELECT 'null_parent_but_present', block_id FROM dd WHERE parent_id IS NULL AND (document_id, block_id) IN (SELECT (document_id, block_id) FROM pa)
UNION ALL SELECT 'chunk_text_not_in_parent', chunk_id FROM c JOIN pa USING (parent_id) WHERE NOT contains(pa.text, c.text)""")
def relational_checks(spark, d):
    """The eight checks between documents, histories, parents and chunks."""
    documents, parents, chunks = _artefacts(spark, d)
    subjects = _blocks(spark, d).where("lang <> 'es'").select("document_id", F.col("lang").alias("code")).distinct()
    return A.relational_findings(documents, _versions(spark, d), parents, chunks, subjects).drop("severity")


@query(f"""WITH {_DESCRIBED}, {_CHUNKS}, q AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY place, chunk_id) AS i, count(*) OVER (PARTITION BY parent_id) AS n FROM c)
SELECT check_name, count(*) AS n FROM (
SELECT 'chunk_id_form' AS check_name FROM q WHERE chunk_id <> parent_id || '__c' || lpad(place::VARCHAR, 3, '0') UNION ALL SELECT 'chunk_sequence' FROM q WHERE place <> i UNION ALL SELECT 'chunk_count' FROM q WHERE n_places <> n
UNION ALL SELECT 'chunk_empty' FROM q WHERE trim(text) = '' UNION ALL SELECT 'chunk_id_repeated' FROM (SELECT chunk_id FROM q GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'chunk_orphan' FROM (SELECT DISTINCT parent_id FROM q WHERE parent_id NOT IN (SELECT parent_id FROM pa))) GROUP BY 1""")
def chunk_checks(spark, d):
    """Ids, sequence, counts, emptiness and orphans of chunks."""
    _, parents, chunks = _artefacts(spark, d)
    return A.chunk_findings(chunks, parents).groupBy("check_name").agg(F.count("*").alias("n"))


@query(f"""WITH {_DESCRIBED}, {_CHUNKS}, w AS (SELECT parent_id FROM y WHERE doc_id % 41 <> 0 AND indexable AND doc_id % 37 <> 0 UNION ALL SELECT NULL FROM y WHERE doc_id % 41 <> 0 AND indexable AND doc_id % 37 = 0)
SELECT count(*) AS n_indexable, count(*) FILTER (parent_id IS NULL OR parent_id NOT IN (SELECT parent_id FROM c)) AS n_without_chunks, count(*) FILTER (parent_id IS NULL OR parent_id NOT IN (SELECT parent_id FROM pa)) AS n_without_parent,
(SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM c WHERE len(text) > 500) AS n_oversized FROM w""")
def chunking_diagnosis(spark, d):
    documents, parents, chunks = _artefacts(spark, d)
    return A.chunking_diagnostics(documents, parents, chunks, 500)


@query(f"""WITH {_DESCRIBED}, {_CHUNKS}, per AS (SELECT parent_id, count(*) AS n, sum(len(text)) AS chars FROM c GROUP BY 1)
SELECT (SELECT sum(n)::BIGINT FROM per) AS n_chunks, (SELECT round(avg(n), 2) FROM per) AS mean_chunks, (SELECT max(n) FROM per) AS most_chunks, (SELECT sum(chars)::BIGINT FROM per) AS chunk_chars, sum(len(text))::BIGINT AS parent_chars, sum(greatest(0, chars - len(text)))::BIGINT AS duplicated_chars FROM pa LEFT JOIN per USING (parent_id)""")
def chunk_efficiency(spark, d):
    _, parents, chunks = _artefacts(spark, d)
    return A.efficiency(parents, chunks)


@query(f"WITH {_DESCRIBED}, {_CHUNKS} SELECT chunk_id, len(text) AS n_chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words, len(text) - 500 AS excess FROM c WHERE len(text) > 500")
def oversized_chunks(spark, d):
    made = A.oversized(_artefacts(spark, d)[2], 500)
    return made.select("chunk_id", *[F.col(c).cast("long").alias(c) for c in ("n_chars", "n_words", "excess")])


@query(f"WITH {_DESCRIBED} SELECT block_type, count(*) AS n, count(*) FILTER (indexable) AS n_indexable FROM y GROUP BY block_type")
def block_types(spark, d):
    return A.block_type_stats(_described(spark, d))


@query(f"""WITH {_BLOCKS}, u AS (SELECT DISTINCT doc_id, document_id, unnest(list_transform(p, lambda x: x.class)) AS class FROM b) SELECT class, count(*) AS n_blocks, count(DISTINCT document_id) AS n_documents FROM u WHERE class IN ('{_LABELS}') GROUP BY class""")
def hierarchy_classes(spark, d):
    return A.hierarchy_stats(_blocks(spark, d))


@query("""WITH n AS (SELECT doc_id AS norm_id, CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE 'N' END AS dz, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'N' END AS ex, CASE WHEN doc_id % 7 = 0 THEN 'En proceso' ELSE 'Finalizado' END AS co, CASE WHEN doc_id % 4 = 0 THEN ['texto'] ELSE ['texto', 'indice', 'metadatos'] END AS av FROM documents),
r AS (SELECT *, coalesce(dz = 'N' AND ex = 'N', false) AS in_force, co = 'Finalizado' AS finished FROM n)
SELECT norm_id, in_force, finished, in_force AND finished AND len(av) = 3 AS meets_criteria, array_to_string(list_filter([CASE WHEN NOT in_force THEN 'not_in_force' END, CASE WHEN NOT finished THEN 'not_finished' END, CASE WHEN len(av) < 3 THEN 'missing:indice,metadatos' END], lambda x: x IS NOT NULL), ';') AS reasons FROM r""")
def inclusion_criteria(spark, d):
    """Which norms belong to a corpus, and why not."""
    i = F.col("doc_id")
    n = _t(spark, d, "documents").select(
        i.alias("norm_id"), F.when(i % 3 == 0, "S").otherwise("N").alias("derogation_status"), F.when(i % 5 > 0, "N").alias("expired_validity"), F.when(i % 7 == 0, "En proceso").otherwise("Finalizado").alias("consolidation"),
        F.when(i % 4 == 0, F.array(F.lit("texto"))).otherwise(F.array(F.lit("texto"), F.lit("indice"), F.lit("metadatos"))).alias("available"),
    )
    return A.inclusion(n, ("metadatos", "indice", "texto")).select("norm_id", "in_force", "finished", "meets_criteria", F.array_join("reasons", ";").alias("reasons"))


@query(f"""WITH {_DESCRIBED}, x1 AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'rt.double_period' WHEN doc_id % 50 = 1 THEN 'chunk.note_leak' WHEN doc_id % 50 = 2 THEN 'block.table_cell_dropped' ELSE 'other' END AS c, CASE WHEN doc_id % 50 IN (1, 3) THEN 'ERROR' ELSE 'WARNING' END AS s FROM b),
a AS (SELECT count(*) FILTER (s = 'ERROR') AS e, bool_or(c = 'rt.double_period') AS dp, bool_or(c LIKE '%note_leak' AND s = 'ERROR') AS nl, bool_or(c = 'block.table_cell_dropped' AND s = 'ERROR') AS tc FROM x1)
SELECT false AS ready, array_to_string(list_filter([CASE WHEN e > 0 THEN 'integrity_errors=' || e END, CASE WHEN dp THEN 'rt_double_period' END, CASE WHEN nl THEN 'note_leak' END, CASE WHEN tc THEN 'table_cell_dropped' END, 'duplicate_corpus_catalog'], lambda x: x IS NOT NULL), ';') AS reasons FROM a""")
def readiness_reasons(spark, d):
    k = F.col("doc_id") % 50
    f = _t(spark, d, "documents").select(F.when(k == 0, "rt.double_period").when(k == 1, "chunk.note_leak").when(k == 2, "block.table_cell_dropped").otherwise("other").alias("check_name"), F.when(k.isin(1, 3), quality.ERROR).otherwise(quality.WARNING).alias("severity"))
    return A.readiness(f, {"duplicate_corpus_catalog": True, "raw_integrity": False}).select("ready", F.array_join("reasons", ";").alias("reasons"))


@query("""WITH i AS (SELECT 'e' || CASE WHEN doc_id = 9 THEN 8 ELSE doc_id END AS id, CASE WHEN doc_id = 5 THEN 4 ELSE doc_id END AS x, CASE WHEN doc_id % 101 = 0 THEN NULL ELSE doc_id % 103 END AS s, doc_id % 103 + 1 - 2 * (doc_id % 97 = 0)::INT AS e FROM documents)
SELECT 'corpus_readiness' AS check_name, 'INFO' AS severity, 'corpus' AS ref UNION ALL SELECT 'revision_pinned', 'WARNING', 'corpus' UNION ALL SELECT 'row_index_continuous', 'ERROR', 'corpus'
UNION ALL SELECT 'ids_unique', 'ERROR', id FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'anchors_present', 'ERROR', id FROM i WHERE s IS NULL UNION ALL SELECT 'anchors_valid', 'ERROR', id FROM i WHERE s < 1 OR e < s""")
def gate_before_encoding(spark, d):
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(
        F.concat(F.lit("e"), F.when(i == 9, 8).otherwise(i).cast("string")).alias("embedding_input_id"), F.when(i == 5, 4).otherwise(i).alias("row_index"), F.when(i % 101 > 0, i % 103).alias("start"), (i % 103 + 1 - 2 * (i % 97 == 0).cast("int")).alias("end")
    )
    return A.gate_a(rows, True, pinned=False, allow_unpinned=True)


@query("""WITH h AS (SELECT doc_id, sha256(doc_id || '|' || coalesce(text, '')) AS h FROM documents), r AS (SELECT doc_id // 4096 AS r, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY 1), f AS (SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY r)) AS f FROM r)
SELECT n, f AS fingerprint, 'm__C1__' || sha256('a|b|' || f)[1:12] AS bundle_id FROM f""")
def ordered_inputs_fingerprint(spark, d):
    """The fingerprint of ordered inputs and the bundle's id made of it."""
    f = A.ordered_fingerprint(_t(spark, d, "documents"), "doc_id", "doc_id", "text")
    return f.withColumn("bundle_id", A.bundle_id("m", "C1", F.lit("a"), F.lit("b"), F.col("fingerprint")))


@query("""WITH s AS (SELECT doc_id, 'f' || doc_id AS name, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS z FROM documents)
SELECT 'file_missing' AS check_name, name AS ref FROM s WHERE doc_id % 50 = 1 UNION ALL SELECT 'file_hash', name FROM s WHERE doc_id % 50 = 2 UNION ALL SELECT 'file_size', name FROM s WHERE doc_id % 50 = 3""")
def manifest_checks(spark, d):
    """Files of a manifest against what is stored."""
    i = F.col("doc_id")
    s = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), i.cast("string")).alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    found = s.where("doc_id % 50 <> 1").select("name", F.when(i % 50 == 2, "?").otherwise(F.col("sha256")).alias("sha256"), F.when(i % 50 == 3, -1).otherwise(F.col("size")).alias("size"))
    return A.file_findings(s, found).drop("severity")


@query("""WITH v AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS published FROM events), i AS (SELECT user_id, event_type, CASE WHEN user_id % 7 > 0 THEN CASE WHEN user_id % 3 = 0 THEN min(published) ELSE max(published) END END AS x, max(published) AS latest FROM v GROUP BY user_id, event_type),
a AS (SELECT i.user_id, i.event_type, any_value(x) AS x, any_value(latest) AS latest, count(*) FILTER (published = x) AS m FROM v JOIN i USING (user_id, event_type) GROUP BY i.user_id, i.event_type),
s AS (SELECT user_id, CASE WHEN x IS NULL THEN 'missing_index_date' WHEN m = 0 THEN 'unresolved' WHEN m > 1 THEN 'ambiguous' WHEN x <> latest THEN 'index_not_max' ELSE 'resolved' END AS status FROM a),
u AS (SELECT 'mismatch' AS bucket FROM s WHERE status <> CASE WHEN user_id % 11 = 0 THEN 'ambiguous' ELSE status END UNION ALL SELECT status FROM s WHERE status <> 'resolved') SELECT bucket, count(*) AS n FROM u GROUP BY bucket""")
def temporal_buckets(spark, d):
    """Stored statuses against those computed anew."""
    v = _t(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("block_id"), F.date_format("ts", "yyyy-MM-dd").alias("published"))
    u = F.col("document_id")
    index = v.groupBy("document_id", "block_id").agg(F.when(u % 7 > 0, F.when(u % 3 == 0, F.min("published")).otherwise(F.max("published"))).alias("index_date"))
    now = blocks.resolve_versions(v, index, ["document_id", "block_id"])
    stored = now.select("document_id", "block_id", F.when(u % 11 == 0, "ambiguous").otherwise(F.col("status")).alias("temporal_status"))
    return A.temporal_findings(now.select("document_id", "block_id", "status"), stored)


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 700)::INT END AS n, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 1000000 ELSE 512 END AS lim FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 512 ELSE 256 END AS "limit", CASE WHEN o_orderkey % 4 = 3 THEN 'tokenizer' ELSE 'declared' END AS origin, n > CASE WHEN o_orderkey % 4 = 3 THEN 512 ELSE 256 END AS truncated,
greatest(0, n - CASE WHEN o_orderkey % 4 = 3 THEN 512 ELSE 256 END) AS excess, 'Ley 1. Título I. ' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Cabecera. ' END || CASE WHEN o_orderkey % 2 = 0 THEN 'Cabecera ' ELSE '' END || p AS retrieval_text,
p LIKE '%..%' AS artificial_stops, 'passage: ' || p AS formatted, CASE WHEN o_orderkey % 3 > 0 THEN p END AS coded_label FROM o""")
def input_profiles(spark, d):
    """Limits, token profiles, retrieval texts and templates."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    o = _t(spark, d, "orders").withColumn("n", F.when(k % 5 > 0, (k % 700).cast("int"))).withColumn("l", T.effective_limit(F.lit(256), F.when(k % 4 == 1, -1).when(k % 4 == 2, 1_000_000).when(k % 4 == 3, 512)))
    prof = T.token_profile(F.col("n"), F.col("l.limit"))
    text = F.when(k % 2 == 0, F.concat(F.lit("Cabecera "), p)).otherwise(p)
    return o.select(
        "o_orderkey", F.col("l.limit").alias("limit"), F.col("l.origin").alias("origin"), prof["truncated"].alias("truncated"), F.when(F.col("n").isNull(), 0).otherwise(prof["excess"]).alias("excess"),
        T.retrieval_text(text, F.lit("Ley 1"), F.array(F.lit("Título I")), F.lit("Cabecera")).alias("retrieval_text"), T.artificial_stops(p).alias("artificial_stops"), T.fill("passage: {text}", text=p).alias("formatted"), T.coded(F.lit("c"), F.when(k % 3 > 0, p))["label"].alias("coded_label"),
    )


@query("""SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS equal, CASE doc_id % 6 WHEN 3 THEN 'lost' WHEN 4 THEN 'added' WHEN 5 THEN 'changed' END AS kind, CASE doc_id % 6 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 END AS first, CASE WHEN doc_id % 6 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS drop_fraction FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def editorial_differences(spark, d):
    """Stored against recomputed paragraphs."""
    i = F.col("doc_id") % 6
    a = F.when(i == 3, F.array("source")).otherwise(F.array("source", "lang"))
    b = F.when(i == 4, F.array("source")).when(i == 5, F.array(F.lit("?"), "lang")).otherwise(F.array("source", "lang"))
    diff = A.editorial_difference(a, b, F.when(i == 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>")))
    return _t(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", diff.alias("x")).select("doc_id", "x.*")
