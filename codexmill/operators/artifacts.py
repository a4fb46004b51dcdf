"""Blocks of versioned norms and their artefacts: semantics, titles, citations, documents, histories, parents, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.text import STRUCTURAL, clean_text, has_body, is_table_class, lower_first
from codexmill.operators.quality import ERROR, INFO, WARNING, missing_references, repeated_keys, rule_findings

#: Block types that are never indexed, roles of block types, label pairs and single labels of titles in their order (fixed values).
EXCLUDED = ("firma", "nota_inicial")
ROLES = {"precepto": "precept", "preambulo": "preamble", "firma": "signature", "nota_inicial": "initial_note"}
PAIRS = (("libro_num", "libro_tit"), ("titulo_num", "titulo_tit"), ("capitulo_num", "capitulo_tit"), ("anexo_num", "anexo_tit"))
SINGLES = ("seccion", "subseccion", "libro", "titulo", "capitulo", "anexo")
FINISHED = "Finalizado"


def classes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda p: F.coalesce(p["class"], F.lit("")))


def _first_text(paragraphs: Column, css: str) -> Column:
    """Text of the first paragraph of a class, null if none."""
    return F.get(F.transform(F.filter(paragraphs, lambda p: p["class"] == css), lambda p: p["text"]), F.lit(0))


def full_title(block_type: Column, paragraphs: Column) -> Column:
    """A block's readable title from array<struct<class, text>>: the first paragraph if it is an article label; of a heading,
    what its leading structural labels say: number and title of the first kind of label there is, else a single label."""
    plain = F.filter(F.transform(paragraphs, lambda p, i: F.when(~F.coalesce(p["class"], F.lit("")).isin(*STRUCTURAL), i)), lambda i: i.isNotNull())
    lead = F.slice(paragraphs, F.lit(1), F.when(F.size(plain) > 0, F.get(plain, F.lit(0))).otherwise(F.size(paragraphs)))
    choices = []
    for number, title in PAIRS:
        n, t = _first_text(lead, number), _first_text(lead, title)
        choices.append(F.when(n.isNotNull(), clean_text(F.concat_ws(". ", F.nullif(n, F.lit("")), F.nullif(t, F.lit(""))))))
        choices.append(F.when(t.isNotNull(), clean_text(t)))
    choices += [_first_text(lead, single) for single in SINGLES]
    first = F.get(paragraphs, F.lit(0))
    return F.when(first["class"] == "articulo", first["text"]).when((block_type == "encabezado") & (F.size(paragraphs) > 0), F.coalesce(*choices))


def is_without_content(paragraphs: Column) -> Column:
    """The body, labels and article label apart, says no more than 'sin contenido'; an empty body does not."""
    body = F.filter(paragraphs, lambda p: ~F.coalesce(p["class"], F.lit("")).isin(*STRUCTURAL, "articulo"))
    words = clean_text(F.array_join(F.transform(body, lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    bare = F.trim(F.regexp_replace(F.lower(words), "[^0-9a-záéíóúñü ]", ""))
    return (F.size(body) > 0) & bare.rlike(r"^sin\s+contenido$")


def suspicious_quote_class(css: Column) -> Column:
    """An article label, a structural label or a table class inside a dropped quote."""
    return (css == "articulo") | css.isin(*STRUCTURAL) | is_table_class(css)


def with_semantics(blocks: DataFrame) -> DataFrame:
    """blocks(block_type, paragraphs array<struct<class, text>>, contains_image, raw_has_table, ..) plus semantic_role,
    has_retrievable_body, is_annex, annex_is_local, contains_table, table_text_available, full_title, is_without_content."""
    p, kind = F.col("paragraphs"), F.col("block_type")
    tabled = F.exists(classes(p), is_table_class)
    numbered = F.array_contains(classes(p), "anexo_num")
    single = F.exists(p, lambda x: (F.coalesce(x["class"], F.lit("")) == "anexo") & F.upper(F.trim(F.coalesce(x["text"], F.lit("")))).startswith("ANEXO"))
    body = has_body(classes(p))
    role = reduce(lambda c, pair: c.when(kind == pair[0], pair[1]), ROLES.items(), F.when(F.lit(False), ""))
    role = role.when(kind == "encabezado", F.when(body & (numbered | single), "annex").when(body, "content_heading").otherwise("structural_heading")).otherwise(kind)
    return blocks.select(
        "*", role.alias("semantic_role"), body.alias("has_retrievable_body"), (numbered | single).alias("is_annex"), (single & ~numbered).alias("annex_is_local"),
        (F.col("raw_has_table") | tabled).alias("contains_table"), tabled.alias("table_text_available"), full_title(kind, p).alias("full_title"), is_without_content(p).alias("is_without_content"),
    )


def with_descriptors(blocks: DataFrame) -> DataFrame:
    """blocks(document_id, block_id, html_url, short_title, block_type, block_title, text, has_retrievable_body,
    temporal_status, ..) plus indexable, excluded_reason, citation_label, source_url. Only resolved blocks are indexed."""
    kind, body, held = F.col("block_type"), F.coalesce("has_retrievable_body", F.lit(False)), F.coalesce(F.col("temporal_status") != "resolved", F.lit(True))
    excluded = F.coalesce(kind.isin(*EXCLUDED), F.lit(False))
    ok = body & ~excluded & (F.coalesce("text", F.lit("")) != "") & ~held
    reason = (
        F.when(held, F.concat(F.lit("temporal_quarantine:"), F.coalesce("temporal_status", F.lit("None")))).when(ok, F.lit(None))
        .when(excluded, F.concat(F.lit("excluded_type:"), kind)).when(~body, "no_retrievable_body")
    )
    base = F.coalesce(F.nullif("short_title", F.lit("")), F.col("document_id"))
    label = F.when(F.coalesce("block_title", F.lit("")) != "", F.concat(base, F.lit(", "), lower_first(F.col("block_title")))).otherwise(base)
    url = F.when(F.coalesce("html_url", F.lit("")) != "", F.concat("html_url", F.lit("#"), "block_id"))
    return blocks.select("*", ok.alias("indexable"), reason.alias("excluded_reason"), label.alias("citation_label"), url.alias("source_url"))


def merged_blocks(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks of index(document_id, block_id, order, ..) and texts(document_id, block_id, text_order, temporal_status, ..): in
    the order of the index, those of the text alone after them; what the index alone has is unresolved."""
    keys = ["document_id", "block_id"]
    last = index.groupBy("document_id").agg((F.max("order") + 1).alias("__next"))
    both = index.withColumn("__listed", F.lit(True)).join(texts.withColumn("__text", F.lit(True)), keys, "full_outer")
    place = F.row_number().over(Window.partitionBy("document_id", F.col("__listed").isNull()).orderBy("text_order")) - 1
    ranked = both.withColumn("__own", place).join(last, "document_id", "left")
    order = F.when(F.col("__listed").isNotNull(), F.col("order")).otherwise(F.coalesce("__next", F.lit(0)) + F.col("__own"))
    status = F.when(F.col("__text").isNull(), "unresolved").otherwise(F.col("temporal_status"))
    return ranked.withColumns({"order": order, "temporal_status": status}).drop("__listed", "__text", "__own", "__next")


def has_current_text() -> Column:
    """Whether a block is resolved and has text."""
    return (F.col("temporal_status") == "resolved") & (F.trim(F.coalesce("text", F.lit(""))) != "")


def document_rows(blocks: DataFrame) -> DataFrame:
    """Descriptors: all but the text; parent_id only where there is current text."""
    parent = F.when(has_current_text(), F.concat_ws("__", "document_id", "block_id"))
    kept = [c for c in ("document_id", "block_id", "order", "block_type", "block_title", "full_title", "semantic_role", "has_retrievable_body", "is_annex", "contains_table", "temporal_status", "indexable", "excluded_reason", "citation_label", "source_url") if c in blocks.columns]
    return blocks.select(*kept, parent.alias("parent_id"))


def history_rows(blocks: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, block_id, temporal_status, versions array<struct<published, norm_id, is_current>>) of every block, those without versions too."""
    listed = versions.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("published", "norm_id", "is_current"))).alias("versions"))
    empty = F.array().cast(listed.schema["versions"].dataType)
    return blocks.select("document_id", "block_id", "temporal_status").join(listed, ["document_id", "block_id"], "left").withColumn("versions", F.coalesce("versions", empty))


def parent_rows(blocks: DataFrame) -> DataFrame:
    """(parent_id, document_id, block_id, order, text) of the blocks with current text: its sole owner."""
    return blocks.where(has_current_text()).select(F.concat_ws("__", "document_id", "block_id").alias("parent_id"), "document_id", "block_id", "order", "text")


def joined_norm(documents: DataFrame, histories: DataFrame, parents: DataFrame) -> DataFrame:
    """Each descriptor with its history and its text, missing ones null."""
    keys = ["document_id", "block_id"]
    return documents.drop("temporal_status").join(histories, keys, "left").join(parents.select(*keys, "text"), keys, "left")


def inclusion(norms: DataFrame, mandatory: tuple[str, ...]) -> DataFrame:
    """norms(norm_id, derogation_status, expired_validity, consolidation, available array<string>) plus in_force, finished,
    meets_criteria and reasons."""
    in_force = F.coalesce((F.col("derogation_status") == "N") & (F.col("expired_validity") == "N"), F.lit(False))
    finished = F.coalesce(F.col("consolidation") == FINISHED, F.lit(False))
    lost = F.array_except(F.array(*map(F.lit, mandatory)), F.coalesce("available", F.array().cast("array<string>")))
    reasons = F.filter(F.array(F.when(~in_force, "not_in_force"), F.when(~finished, "not_finished"), F.when(F.size(lost) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(lost), ",")))), lambda r: r.isNotNull())
    return norms.select("*", in_force.alias("in_force"), finished.alias("finished"), (F.size(reasons) == 0).alias("meets_criteria"), reasons.alias("reasons"))


def missing_cells(cells: Column, body: Column) -> Column:
    """Cells of four characters or more with a letter that the body does not contain."""
    return F.filter(cells, lambda c: (F.length(c) >= 4) & c.rlike(r"\p{L}") & ~F.contains(body, c))


def oversized(chunks: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, n_chars, n_words, excess) of the chunks longer than the limit."""
    n = F.length("text")
    return chunks.where(n > limit).select("chunk_id", n.alias("n_chars"), F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n_words"), (n - limit).alias("excess"))


def _found(rows: DataFrame, name: str, ref: str, severity: str = ERROR) -> DataFrame:
    return rows.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.col(ref).cast("string").alias("ref"))


def relational_findings(documents: DataFrame, versions: DataFrame, parents: DataFrame, chunks: DataFrame, subjects: DataFrame) -> DataFrame:
    """The eight checks between artefacts, by the keys they share across all documents.

    documents(document_id, block_id, parent_id), versions(document_id, block_id, published, norm_id, is_current),
    parents(parent_id, document_id, block_id, text, published, norm_id), chunks(chunk_id, document_id, parent_id, text,
    subject_codes), subjects(document_id, code)."""
    keys = ["document_id", "block_id"]
    known = documents.select(*keys)
    current = versions.where("is_current").groupBy(*keys).agg(F.min(F.struct("published", "norm_id")).alias("v"))
    codes = chunks.select("chunk_id", "document_id", F.explode("subject_codes").alias("code"))
    differ = ~F.col("v.published").eqNullSafe(F.col("published")) | ~F.col("v.norm_id").eqNullSafe(F.col("norm_id"))
    with_text = chunks.select("chunk_id", "parent_id", F.col("text").alias("part")).join(parents.select("parent_id", "text"), "parent_id")
    lost = [
        _found(parents.join(known, keys, "left_anti"), "parent_block_missing", "parent_id"),
        _found(versions.select(*keys).distinct().join(known, keys, "left_anti"), "history_block_missing", "block_id"),
        _found(documents.where("parent_id is not null").join(parents.select("parent_id"), "parent_id", "left_anti"), "parent_id_dangling", "block_id"),
        _found(chunks.join(parents.select("parent_id"), "parent_id", "left_anti"), "chunk_parent_missing", "chunk_id"),
        _found(codes.join(subjects.select("document_id", "code"), ["document_id", "code"], "left_anti").select("chunk_id").distinct(), "subject_code_unknown", "chunk_id"),
        _found(parents.join(current, keys).where(differ), "current_version_mismatch", "parent_id"),
        _found(documents.where("parent_id is null").join(parents.select(*keys), keys, "left_semi"), "null_parent_but_present", "block_id"),
        _found(with_text.where(~F.contains("text", F.coalesce("part", F.lit("")))), "chunk_text_not_in_parent", "chunk_id"),
    ]
    return reduce(DataFrame.unionByName, lost)


def chunk_findings(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Ids by their form and once each, parents that exist, places 1..n with the count they state, no empty text.

    chunks(chunk_id, parent_id, place, n_places, text); an id is its parent's, '__c' and the place in three digits."""
    form = F.concat("parent_id", F.lit("__c"), F.lpad(F.col("place").cast("string"), F.greatest(F.lit(3), F.length(F.col("place").cast("string"))), F.lit("0")))
    own = Window.partitionBy("parent_id")
    placed = chunks.withColumn("__i", F.row_number().over(own.orderBy("place", "chunk_id"))).withColumn("__n", F.count("*").over(own))
    rules = [("chunk_id_form", ERROR, F.col("chunk_id") != form), ("chunk_sequence", ERROR, F.col("place") != F.col("__i")), ("chunk_count", ERROR, F.col("n_places") != F.col("__n")), ("chunk_empty", ERROR, F.trim(F.coalesce("text", F.lit(""))) == "")]
    found = rule_findings(placed, F.col("chunk_id"), rules)
    return found.unionByName(repeated_keys(chunks, ["chunk_id"], "chunk_id_repeated")).unionByName(missing_references(chunks, "parent_id", parents, "parent_id", "chunk_orphan"))


def chunking_diagnostics(documents: DataFrame, parents: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """One row: indexable blocks, chunks, indexable blocks without chunks or without a parent, chunks over the limit."""
    wanted = documents.where("indexable").select("parent_id").join(parents.select("parent_id", F.lit(1).alias("p")), "parent_id", "left").join(chunks.select("parent_id", F.lit(1).alias("c")).distinct(), "parent_id", "left")
    a = wanted.agg(F.count("*").alias("n_indexable"), F.count_if(F.col("c").isNull()).alias("n_without_chunks"), F.count_if(F.col("p").isNull()).alias("n_without_parent"))
    return a.crossJoin(chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.length("text") > limit).alias("n_oversized")))  # one row each


def efficiency(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: characters of parents and of chunks, chunks of a parent (mean to 2 digits, most), characters chunked more than once."""
    per = chunks.groupBy("parent_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    c = per.agg(F.sum("n").alias("n_chunks"), F.round(F.avg("n"), 2).alias("mean_chunks"), F.max("n").alias("most_chunks"), F.sum("chars").alias("chunk_chars"))
    p = parents.join(per.select("parent_id", "chars"), "parent_id", "left").agg(F.sum(F.length("text")).alias("parent_chars"), F.sum(F.greatest(F.lit(0), F.col("chars") - F.length("text"))).alias("duplicated_chars"))
    return c.crossJoin(p)


def block_type_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce("block_type", F.lit("(none)")).alias("block_type")).agg(F.count("*").alias("n"), F.count_if("indexable").alias("n_indexable"))


def hierarchy_stats(blocks: DataFrame) -> DataFrame:
    """(class, n_blocks, n_documents): structural classes, each once a block."""
    seen = blocks.select("document_id", F.explode(F.array_distinct(classes(F.col("paragraphs")))).alias("class")).where(F.col("class").isin(*STRUCTURAL))
    return seen.groupBy("class").agg(F.count("*").alias("n_blocks"), F.count_distinct("document_id").alias("n_documents"))


def temporal_findings(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """(bucket, n) of blocks whose stored status is not the one computed anew (mismatch) and of each status but resolved.

    resolved(document_id, block_id, status) computed from versions, documents(document_id, block_id, temporal_status)."""
    both = documents.join(resolved, ["document_id", "block_id"], "left")
    bucket = F.filter(F.array(F.when(~F.col("temporal_status").eqNullSafe(F.col("status")), "mismatch"), F.when(F.col("status") != "resolved", F.col("status"))), lambda b: b.isNotNull())
    return both.select(F.explode(bucket).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


#: Reasons that single checks add to a report of readiness (fixed values).
BLOCKING = {
    "rt.double_period": "rt_double_period", "block.heading_body_not_indexed": "substantive_heading_not_indexed", "block.note_leak": "note_leak", "chunk.note_leak": "note_leak", "block.editorial_leak": "note_leak",
    "chunk.editorial_leak": "note_leak", "block.editorial_invariant": "editorial_invariant", "block.table_cell_dropped": "table_cell_dropped",
}


def readiness(findings: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
    """One row (ready, reasons): the number of errors first, then what single checks and outer flags block, each once. A
    double stop blocks whatever its severity, the other checks as errors only."""
    errors = F.count_if(F.col("severity") == ERROR)
    outer = [F.lit(name) for name, on in (flags or {}).items() if on]
    found = {}
    for check, reason in BLOCKING.items():
        found.setdefault(reason, []).append((F.col("check_name") == check) & (F.lit(check == "rt.double_period") | (F.col("severity") == ERROR)))
    parts = [F.when(errors > 0, F.concat(F.lit("integrity_errors="), errors.cast("string")))]
    parts += [F.when(F.coalesce(F.bool_or(reduce(lambda a, b: a | b, tests)), F.lit(False)), reason) for reason, tests in found.items()]
    one = findings.agg(F.filter(F.array(*parts, *outer), lambda r: r.isNotNull()).alias("reasons"))
    return one.select((F.size("reasons") == 0).alias("ready"), "reasons")


def gate_a(inputs: DataFrame, ready: bool | None, pinned: bool, allow_unpinned: bool = False, remote_code: bool = False, reviewed: bool = False, truncated: int = 0) -> DataFrame:
    """Findings before encoding, of inputs(embedding_input_id, row_index, start, end): corpus, revisions and code are fit, there
    are inputs, ids once each, indices 0..n-1, anchors there and in order. The index test needs no order: n values between
    0 and n-1, all different."""
    s = inputs.agg(F.count("*").alias("n"), F.count_distinct("row_index").alias("d"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"))
    whole = (F.col("n") == 0) | ((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
    fixed = [
        ("corpus_readiness", INFO if ready else ERROR, F.lit(True)), ("revision_pinned", WARNING if allow_unpinned else ERROR, F.lit(not pinned)), ("remote_code_reviewed", ERROR, F.lit(remote_code and not reviewed)),
        ("inputs_present", ERROR, F.col("n") == 0), ("no_truncation", ERROR, F.lit(truncated != 0)), ("row_index_continuous", ERROR, ~whole),
    ]
    anchors = [("anchors_present", ERROR, F.col("start").isNull() | F.col("end").isNull()), ("anchors_valid", ERROR, (F.col("start") < 1) | (F.col("end") < F.col("start")))]
    own = rule_findings(inputs, F.col("embedding_input_id"), anchors)
    return rule_findings(s, F.lit("corpus"), fixed).unionByName(repeated_keys(inputs, ["embedding_input_id"], "ids_unique")).unionByName(own)


def report_checks(findings: DataFrame) -> DataFrame:
    """One row (checks, n_errors, n_warnings, n_infos): the distinct checks, sorted, and counts by severity."""
    return findings.agg(F.array_sort(F.collect_set("check_name")).alias("checks"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}s") for s in (ERROR, WARNING, INFO)])


def file_findings(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a manifest(name, sha256, size) that are missing or differ in hash or size from found(name, sha256, size)."""
    both = stated.join(found.select("name", F.col("sha256").alias("h"), F.col("size").alias("s")), "name", "left")
    return rule_findings(both, F.col("name"), [("file_missing", ERROR, F.col("h").isNull()), ("file_hash", ERROR, F.col("h") != F.col("sha256")), ("file_size", ERROR, F.col("s") != F.col("size"))])


def ordered_fingerprint(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row (n, fingerprint): sha256 over rows in the order of a dense index. Hashes are joined in runs of 4096 rows, then
    the runs' hashes, so no task holds a hash of every row; the order inside and between runs is that of the index."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)
    runs = rows.select(F.col(order).alias("i"), h.alias("h")).groupBy(F.floor(F.col("i") / 4096).alias("r")).agg(F.count("*").alias("n"), joined("i").alias("h"))
    return runs.agg(F.sum("n").alias("n"), joined("r").alias("fingerprint"))


def bundle_id(alias: str, view: str, *fingerprints: Column) -> Column:
    """alias__view__ and the first 12 digits of the hash of the fingerprints."""
    return F.concat_ws("__", F.lit(alias), F.lit(view), F.left(F.sha2(F.concat_ws("|", *fingerprints), 256), F.lit(12)))


def contract_fingerprint(**fields) -> Column:
    """sha256 of the fields as JSON with sorted names and no white space; null fields stay."""
    import hashlib
    import json

    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return F.lit(hashlib.sha256(text.encode()).hexdigest())


def editorial_difference(persisted: Column, recomputed: Column, dropped: Column) -> Column:
    """struct<equal, kind, first, drop_fraction> of two ordered lists of paragraphs: lost, added or changed ones and the first
    place where they differ; the share of what a new reading drops."""
    n, m = F.size(persisted), F.size(recomputed)
    same = F.zip_with(persisted, recomputed, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    kind = F.when(n < m, "lost").when(n > m, "added").when(first > 0, "changed")
    return F.struct((kind.isNull()).alias("equal"), kind.alias("kind"), F.when(kind.isNotNull(), F.when(first > 0, first.cast("int"))).alias("first"), (F.size(dropped) / F.greatest(m + F.size(dropped), F.lit(1))).alias("drop_fraction"))
