"""Audit of norms by recomputation: rules as a table, compiled to one expression over nested rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.text import STRUCTURAL, is_table_class
from codexmill.operators.artifacts import EXCLUDED
from codexmill.operators.stored import store

#: Severities and classes of findings, block types, the version of the document's contract and its keys (fixed values).
ERROR, WARN = "ERROR", "WARN"
REVIEW, ACCEPTED, LATER = "Revisar antes de embeddings", "Aceptable MVP", "Mejora posterior"
BLOCK_TYPES = ("nota_inicial", "preambulo", "encabezado", "precepto", "firma")
SCHEMA_VERSION = "boe_legal_document_v2"
DOCUMENT_KEYS = ("schema_version", "document_id", "source", "metadata", "analysis", "blocks", "generation_meta")
#: Patterns of dates, tags and editorial formulas in texts (fixed values).
DATE, DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
TAG, LEAK = r"</?[a-zA-Z][^<>]*>", r"(?i)(t[eéEÉ]ngase en cuenta|redacci[oóOÓ]n(es)?\s+anterior(es)?\s*:)"
#: Levels of the hierarchy and the paragraph class that opens each, the first that a heading has (fixed values).
LEVELS = {"book": "libro_num", "title": "titulo_num", "chapter": "capitulo_num", "section": "seccion", "subsection": "subseccion", "annex": "anexo_num"}
#: Characters of a note that a finding shows.
SHOWN = 80


@dataclass(frozen=True)
class Rule:
    """A finding for every row where `when` holds, or, with `each`, for every item of that array for which it holds.

    when, message, ref, evidence and each are SQL expressions over the row's columns; those of a rule with `each` may name
    `item`. A condition that is null does not hold."""

    check: str
    severity: str
    classification: str
    when: str
    message: str
    ref: str = "NULL"
    evidence: str = "NULL"
    each: str | None = None

    def sql(self) -> str:
        parts = {"check_name": f"'{self.check}'", "severity": f"'{self.severity}'", "classification": f"'{self.classification}'"}
        parts |= {"ref": f"CAST({self.ref} AS STRING)", "message": f"CAST({self.message} AS STRING)", "evidence": f"CAST({self.evidence} AS STRING)"}
        made = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"
        if self.each:
            return f"transform(filter({self.each}, item -> coalesce({self.when}, false)), item -> {made})"
        return f"filter(array({made}), one -> coalesce({self.when}, false))"


def compiled(rules: list[Rule]) -> Column:
    """One expression for all rules: an array of findings, in the order of the rules."""
    return F.expr("flatten(array(" + ", ".join(r.sql() for r in rules) + "))")


def findings(rows: DataFrame, rules: list[Rule], document: str = "document_id") -> DataFrame:
    """(check_name, severity, classification, document_id, ref, message, evidence) of every rule that holds on a row; no shuffle."""
    found = rows.select(F.col(document).cast("string").alias("document_id"), F.explode(compiled(rules)).alias("f"))
    return found.select("f.check_name", "f.severity", "f.classification", "document_id", "f.ref", "f.message", "f.evidence")


DOCUMENT_RULES = [
    Rule("doc.schema", ERROR, REVIEW, f"NOT (schema_version <=> '{SCHEMA_VERSION}')", "concat('schema_version is ', coalesce(schema_version, 'null'))"),
    Rule("doc.keys", ERROR, REVIEW, "NOT array_contains(keys, item)", "concat('top-level key is missing: ', item)", each="array(" + ", ".join(f"'{k}'" for k in DOCUMENT_KEYS) + ")"),
    Rule("doc.identity", ERROR, REVIEW, "metadata.identifier <> '' AND NOT (metadata.identifier <=> document_id)", "concat('metadata.identifier is ', metadata.identifier)"),
    Rule(
        "doc.date", WARN, REVIEW, f"item.value <> '' AND NOT item.value RLIKE '{DATE}'", "concat('not an ISO date: ', item.value)", ref="item.name",
        each="array(" + ", ".join(f"named_struct('name', '{k}', 'value', metadata.{k})" for k in ("publication_date", "document_date", "effective_date")) + ")",
    ),
    Rule("doc.date", WARN, REVIEW, f"metadata.last_update_datetime <> '' AND NOT metadata.last_update_datetime RLIKE '{DATETIME}'", "concat('not an ISO datetime: ', metadata.last_update_datetime)", ref="'last_update_datetime'"),
    Rule("doc.manifest_ref", ERROR, REVIEW, "manifest_ref LIKE '/%' OR contains(manifest_ref, ':')", "concat('manifest_ref is no stable relative path: ', manifest_ref)"),
]

TEMPORAL_RULES = [
    Rule("block.temporal_quarantine", ERROR, REVIEW, "size(versions) > 0 AND status <> 'resolved'", "concat('no current version by the index: ', status)", "block_id", "status"),
    Rule("block.temporal_inconsistent", ERROR, REVIEW, "size(versions) > 0 AND status <> 'resolved' AND (latest IS NOT NULL OR indexable)", "'not resolved, yet not held back'", "block_id"),
    Rule(
        "block.temporal_mismatch", ERROR, REVIEW, "size(versions) > 0 AND status = 'resolved' AND indexable AND NOT (latest.publication_date <=> index_date AND latest.source_norm_id <=> selected_norm_id)",
        "'the stored version is not the current one by the index'", "block_id", "concat(coalesce(latest.publication_date, 'None'), ' != ', index_date)",
    ),
    Rule("block.future_effective", WARN, ACCEPTED, "size(versions) > 0 AND status = 'resolved' AND latest.validity_date > processing_date", "concat('takes effect on ', latest.validity_date)", "block_id"),
]

#: The notes of a current version without the white space around them.
_NOTES = r"transform(coalesce(latest.modification_notes, array()), n -> regexp_replace(n.text, r'(?U)^\s+|\s+$', ''))"
_IN = ", ".join(f"'{t}'" for t in BLOCK_TYPES)
BLOCK_RULES = [
    Rule("block.type", WARN, REVIEW, f"NOT coalesce(block_type IN ({_IN}), false)", "concat('unknown block_type: ', coalesce(block_type, 'null'))", "block_id"),
    Rule("block.parent_id", ERROR, REVIEW, "parent_id <> concat(document_id, '__', block_id)", "'parent_id is not document and block joined by two underscores'", "block_id"),
    Rule("block.is_latest", ERROR, REVIEW, "size(versions) > 0 AND n_latest <> 1", "concat('versions marked as latest: ', CAST(n_latest AS STRING))", "block_id"),
    Rule("block.versions_metadata", ERROR, LATER, "exists(versions, v -> v.text IS NOT NULL)", "'versions hold more than metadata'", "block_id"),
    Rule("block.indexable", WARN, ACCEPTED, "NOT (indexable <=> expected_indexable)", "concat('indexable is ', coalesce(CAST(indexable AS STRING), 'null'), ', the rule says ', CAST(expected_indexable AS STRING))", "block_id"),
    Rule("block.heading_body_not_indexed", ERROR, REVIEW, "block_type = 'encabezado' AND has_body AND NOT coalesce(indexable, false)", "'a heading with a body is not indexed'", "block_id"),
    Rule("block.structural_indexed", ERROR, REVIEW, "block_type = 'encabezado' AND NOT has_body AND indexable", "'a mere label is indexed'", "block_id"),
    Rule("block.source_url", ERROR, REVIEW, "html_url <> '' AND NOT (source_url <=> concat(html_url, '#', block_id))", "'source_url is not html_url and block joined by #'", "block_id"),
    Rule("block.text_tags", ERROR, REVIEW, f"latest.text RLIKE '{TAG}'", "'the text holds tags'", "block_id"),
    Rule("block.note_leak", ERROR, REVIEW, "item <> '' AND contains(latest.text, item)", "'a modification note stands in the text'", "block_id", f"left(item, {SHOWN})", _NOTES),
    Rule("block.editorial_leak", ERROR, REVIEW, f"latest.text RLIKE r'{LEAK}'", "'an editorial formula stands in the text'", "block_id", f"regexp_extract(latest.text, r'{LEAK}', 1)"),
]

_BODY = " OR ".join(f"hierarchy.{k} <> ''" for k in LEVELS if k != "annex")
SEMANTIC_RULES = [
    Rule("block.semantic_role", WARN, LATER, "block_type = 'encabezado' AND is_annex AND has_body AND NOT (semantic_role <=> 'annex')", "concat('an annex has the role ', coalesce(semantic_role, 'null'))", "block_id"),
    Rule("block.semantic_role", WARN, LATER, "block_type = 'encabezado' AND has_body AND semantic_role = 'structural_heading'", "'a heading with a body has the role structural_heading'", "block_id"),
    Rule("block.annex_dragged", WARN, REVIEW, f"hierarchy.annex <> '' AND ({_BODY})", "'an annex beside levels of the body'", "block_id"),
    Rule("block.annex_local_context_missing", WARN, LATER, "is_annex AND semantic_role = 'annex' AND coalesce(hierarchy.annex, '') = ''", "'an annex without its level'", "block_id"),
]

#: Not among the checks that make a norm ready: what is stored against what the headings of the norm give anew.
HIERARCHY_RULES = [
    Rule("block.hierarchy_stale", WARN, REVIEW, "NOT (item.stored <=> item.anew)", "concat(item.level, ' is ', coalesce(item.stored, 'null'))", "block_id", "item.anew",
         "array(" + ", ".join(f"named_struct('level', '{k}', 'stored', hierarchy.{k}, 'anew', recomputed.{k})" for k in LEVELS) + ")"),
]


def _in_force() -> Column:
    return F.filter("versions", lambda v: v["publication_date"] == F.col("index_date"))


def with_resolution(blocks: DataFrame) -> DataFrame:
    """blocks(versions array<struct<publication_date, source_norm_id, ..>>, index_date, ..) plus status and selected_norm_id, both
    worked out inside the row from its versions, not taken from what is stored."""
    newest = F.array_max(F.transform("versions", lambda v: v["publication_date"]))
    n = F.size(_in_force())
    status = (
        F.when(F.col("index_date").isNull(), "missing_index_date").when(n == 0, "unresolved").when(n > 1, "ambiguous")
        .when(F.col("index_date") != newest, "index_not_max").otherwise("resolved")
    )
    return blocks.withColumn("status", status).withColumn("selected_norm_id", F.when(F.col("status") == "resolved", F.get(_in_force(), F.lit(0))["source_norm_id"]))


def with_body(blocks: DataFrame) -> DataFrame:
    """blocks(block_type, latest struct<text, paragraphs, ..>, versions, ..) plus has_body, expected_indexable and n_latest."""
    body = F.coalesce(F.exists("latest.paragraphs", lambda p: ~F.coalesce(p["class"], F.lit("")).isin(*STRUCTURAL)), F.lit(False))
    allowed = ~F.coalesce(F.col("block_type").isin(*EXCLUDED), F.lit(False))
    expected = body & allowed & (F.coalesce("latest.text", F.lit("")) != "")
    return blocks.withColumns({"has_body": body, "expected_indexable": expected, "n_latest": F.size(F.filter("versions", lambda v: F.coalesce(v["is_latest"], F.lit(False))))})


def with_hierarchy(blocks: DataFrame) -> DataFrame:
    """blocks(document_id, order, block_type, latest, ..) plus recomputed, a struct of LEVELS: the heading state after each block.

    A heading block that has a current version opens the first level that one of its paragraphs names (the last such
    paragraph's text); that closes all lower levels and the annex, an annex closes all others. Resets of a level are counted
    along the order of a norm; in the stretch since the last one, the last text of the level holds."""
    texts = {level: _last_of(css) for level, css in LEVELS.items()}
    opened = F.lit(None).cast("string")
    for level in reversed(LEVELS):
        opened = F.when(texts[level].isNotNull(), level).otherwise(opened)
    own = F.when((F.col("block_type") == "encabezado") & F.col("latest").isNotNull(), opened)
    out = blocks.withColumn("__level", own)
    names, run = list(LEVELS), Window.partitionBy("document_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    for k, level in enumerate(names):
        closers = [*names[:k], "annex"] if level != "annex" else names[:-1]
        out = out.withColumn(f"__r{k}", F.count_if(F.col("__level").isin(closers)).over(run))
    held = []
    for k, level in enumerate(names):
        stretch = Window.partitionBy("document_id", f"__r{k}").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
        held.append(F.last(F.when(F.col("__level") == level, texts[level]), ignorenulls=True).over(stretch).alias(level))
    return out.withColumn("recomputed", F.struct(*held)).drop("__level", *[f"__r{k}" for k in range(len(names))])


def _last_of(css: str) -> Column:
    own = F.filter("latest.paragraphs", lambda p: p["class"] == css)
    return F.when(F.size(own) > 0, F.coalesce(F.element_at(own, -1)["text"], F.lit("")))


def audit_blocks(blocks: DataFrame, processing_date: str, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of blocks(document_id, block_id, order, block_type, semantic_role, is_annex, parent_id, html_url, source_url,
    indexable, hierarchy struct of LEVELS, index_date, versions array<struct<publication_date, source_norm_id, is_latest, text>>,
    latest struct<publication_date, source_norm_id, validity_date, text, paragraphs array<struct<class, text>>, modification_notes
    array<struct<text>>>), by the temporal, block and semantic rules unless others are given.

    What rules hold against what is stored is worked out anew: the version in force, the body, whether a block is to be
    indexed, the heading state. Only the heading state needs rows of a norm together. Null arrays count as empty, a null
    latest as a block held back; repeated rows give their findings each; an empty table gives none."""
    rules = rules or [*TEMPORAL_RULES, *BLOCK_RULES, *SEMANTIC_RULES]
    held = blocks.withColumn("versions", F.coalesce("versions", F.array().cast(blocks.schema["versions"].dataType))).withColumn("processing_date", F.lit(processing_date))
    held = with_body(with_resolution(held))
    if any("recomputed" in (r.each or "") + r.when for r in rules):
        held = with_hierarchy(held)
    return findings(held, rules)


def audit_documents(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of documents(document_id, schema_version, keys array<string>, manifest_ref, metadata struct<identifier,
    publication_date, document_date, effective_date, last_update_datetime>); keys are those that the stored object has."""
    return findings(documents, rules or DOCUMENT_RULES)


#: From this share of dropped paragraphs on, and for these lengths of cells and samples, a block is shown (fixed values).
DROP_SHARE, CELL_CHARS = 0.5, 4
EDITORIAL_RULES = [
    Rule("block.editorial_invariant", ERROR, REVIEW, "absent", "'the block is not in the raw norm'", "block_id"),
    Rule(
        "block.editorial_invariant", ERROR, REVIEW, "first IS NOT NULL", "concat(IF(n_stored > n_kept, 'leak', 'overdeletion'), ': stored paragraphs are not those of the raw norm from place ', CAST(first AS STRING), ' on')",
        "block_id", "concat(coalesce(expected, 'None'), ' | ', coalesce(actual, 'None'))",
    ),
    Rule("block.editorial_drop_structural", WARN, REVIEW, "size(suspicious) > 0", "concat('dropped from quotes: ', array_join(suspicious, ', '))", "block_id", "sample"),
    Rule("block.editorial_drop_fraction", WARN, REVIEW, f"dropped_fraction > {DROP_SHARE}", "concat('dropped ', CAST(n_dropped AS STRING), ' of ', CAST(n_kept + n_notes + n_dropped AS STRING))", "block_id", "sample"),
    Rule("block.table_cell_dropped", ERROR, REVIEW, "n_cells > 0", "concat(CAST(n_cells AS STRING), ' cells of tables are not in the text')", "block_id", "left(array_join(cells, ' | '), 160)"),
]


def editorial_state(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """What raw rows (`sources.stream`, with document_id for file) say of stored blocks(document_id, block_id, index_date, latest
    struct<publication_date, source_norm_id, text, paragraphs array<struct<class, text>>>): a row for each block that has a
    current version, if the raw norm lacks the block (absent) or both sides name the same version as the one in force.

    The version in force is worked out from the raw versions. Paragraphs are compared by their places in one join and one
    aggregation: first is the first place where both lists differ (null: none), expected and actual what stands there; n_kept,
    n_stored, n_notes, n_dropped, dropped_fraction, dropped_classes map<class, n>, suspicious classes, sample; n_cells loose
    cells of CELL_CHARS characters and a letter that the text lacks, cells the first three. Norms with an error are left out. raw,
    the blocks compared and the placed rows are each written once, as several joins read them."""
    keys, raw = ["document_id", "block_id"], store(raw, "norm-rows")
    failed = raw.where(F.col("error").isNotNull()).select("document_id").distinct()
    raw = raw.join(failed, "document_id", "left_anti")
    day = F.when(F.col("published").rlike("^[0-9]{8}$"), F.regexp_replace("published", "^(....)(..)(..)$", "$1-$2-$3"))
    known = raw.where("role = 'block'").select(*keys).distinct()
    versions = raw.where("role = 'version'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("version", day.alias("publication_date"), F.col("norm_id").alias("source_norm_id")))).alias("versions"))
    present = raw.where("role = 'block'").select("document_id").distinct().withColumn("__read", F.lit(True))
    current = stored.where("latest IS NOT NULL").select(*keys, "index_date", "latest")
    found = current.join(present, "document_id").join(known.withColumn("__known", F.lit(True)), keys, "left").join(versions, keys, "left")
    none = F.array().cast(versions.schema["versions"].dataType)
    resolved = with_resolution(found.withColumn("versions", F.coalesce("versions", none)))
    agreed = (F.col("status") == "resolved") & F.col("selected_norm_id").eqNullSafe(F.col("latest.source_norm_id")) & F.col("index_date").eqNullSafe(F.col("latest.publication_date"))
    chosen = resolved.select(*keys, "latest", F.col("__known").isNull().alias("absent"), F.when(agreed, F.get(_in_force(), F.lit(0))["version"]).alias("version")).where("absent OR version IS NOT NULL")
    chosen = store(chosen, "norm-blocks")
    own = raw.where("role NOT IN ('block', 'version')").join(chosen.where("NOT absent").select(*keys, "version", F.col("latest.text").alias("body")), [*keys, "version"])
    letter = F.col("text").rlike(r"\p{L}")
    lost = (F.col("role") == "cell") & (F.length("text") >= CELL_CHARS) & letter & ~F.contains(F.coalesce("body", F.lit("")), F.col("text"))
    order = Window.partitionBy(*keys, "role").orderBy("place")
    placed = own.select(*keys, "role", "class", "text", "place", lost.alias("lost"), (F.row_number().over(order) - 1).alias("at"))
    placed = store(placed, "placed-rows")
    kept = placed.where("role = 'kept'").select(*keys, "at", F.col("text").alias("expected"), F.lit(True).alias("__e"))
    held = chosen.where("NOT absent").select(*keys, F.posexplode("latest.paragraphs").alias("at", "p")).select(*keys, "at", F.col("p.text").alias("actual"), F.lit(True).alias("__a"))
    pairs = kept.join(held, [*keys, "at"], "full_outer")
    unlike = ~F.col("expected").eqNullSafe(F.col("actual")) | F.col("__e").isNull() | F.col("__a").isNull()
    compared = pairs.groupBy(*keys).agg(
        F.count("__e").alias("n_kept"), F.count("__a").alias("n_stored"), F.min(F.when(unlike, F.struct("at", "expected", "actual"))).alias("f"),
    ).select(*keys, "n_kept", "n_stored", F.col("f.at").alias("first"), F.col("f.expected").alias("expected"), F.col("f.actual").alias("actual"))
    cut = lambda c: F.left(c, F.lit(SHOWN))
    by_class = placed.where("role = 'dropped'").groupBy(*keys, "class").agg(F.count("*").alias("n"), F.min(F.struct("place", cut(F.col("text")).alias("text"))).alias("s"))
    suspect = F.col("class").isin(*STRUCTURAL) | (F.col("class") == "articulo") | is_table_class(F.col("class"))
    dropped = by_class.groupBy(*keys).agg(
        F.sum("n").alias("n_dropped"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("dropped_classes"), F.array_sort(F.collect_list(F.when(suspect, F.col("class")))).alias("suspicious"), F.min("s")["text"].alias("sample"),
    )
    others = placed.groupBy(*keys).agg(F.count_if(F.col("role") == "note").alias("n_notes"), F.count_if("lost").alias("n_cells"))
    first = Window.partitionBy(*keys).orderBy(F.col("class") != "td", "place")
    shown = placed.where("lost").withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda c: c["text"]).alias("cells"))
    out = chosen.select(*keys, "absent")
    for part in (compared, dropped, others, shown):
        out = out.join(part, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_kept", "n_stored", "n_notes", "n_dropped", "n_cells")}
    share = F.col("n_dropped") / F.greatest(F.col("n_kept") + F.col("n_notes") + F.col("n_dropped"), F.lit(1))
    return out.withColumns(zero).withColumn("dropped_fraction", share)


def editorial_findings(state: DataFrame) -> DataFrame:
    """Findings of EDITORIAL_RULES over `editorial_state`."""
    return findings(state, EDITORIAL_RULES)


def drop_records(state: DataFrame) -> DataFrame:
    """(document_id, block_id, n_kept, n_notes, n_dropped, dropped_fraction to 3 digits, dropped_classes, sample, anomaly) of the blocks that drop anything."""
    anomaly = F.array_compact(F.array(F.when(F.col("dropped_fraction") > DROP_SHARE, "high_fraction"), F.when(F.size("suspicious") > 0, "structural_class")))
    return state.where("n_dropped > 0").select("document_id", "block_id", "n_kept", "n_notes", "n_dropped", F.round("dropped_fraction", 3).alias("dropped_fraction"), "dropped_classes", "sample", anomaly.alias("anomaly"))


def drop_summary(records: DataFrame) -> DataFrame:
    """One row of `drop_records`: n_blocks, n_dropped, n_anomalies, and dropped_classes array<struct<class, n>> by falling n, then class."""
    per = records.select(F.explode("dropped_classes").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n"))
    classes = per.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "class", "n"))).alias("c")).select(F.transform("c", lambda c: F.struct(c["class"], c["n"])).alias("dropped_classes"))
    totals = records.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("n_dropped"), F.lit(0).cast("long")).alias("n_dropped"), F.count_if(F.size("anomaly") > 0).alias("n_anomalies"))
    return totals.crossJoin(F.broadcast(classes))  # one row each
