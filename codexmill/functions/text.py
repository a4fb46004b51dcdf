"""Scalar text expressions. Java's classes are ASCII, so Unicode patterns carry (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paragraph classes that only structure a block (fixed values).
STRUCTURAL = (
    "libro", "libro_num", "libro_tit", "titulo", "titulo_num", "titulo_tit", "capitulo", "capitulo_num", "capitulo_tit",
    "seccion", "subseccion", "anexo", "anexo_num", "anexo_tit",
)


def clean_text(c: Column) -> Column:
    """Unicode white space collapsed and stripped; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_date(c: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD by its digits only, no calendar; anything else is null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def normalize_datetime(c: Column) -> Column:
    """YYYYMMDDThhmmssZ to YYYY-MM-DDThh:mm:ssZ by its digits; anything else is null."""
    t = F.trim(c)
    pattern = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"
    return F.when(t.rlike(pattern), F.regexp_replace(t, pattern, "$1-$2-$3T$4:$5:$6Z"))


def first_match(c: Column, pattern: str) -> Column:
    """The first match of a pattern, null if none."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def norm_id(c: Column) -> Column:
    return first_match(c, r"BOE-[A-Z]-\d{4}-\d+")


def lower_first(c: Column) -> Column:
    """Lowers the first letter if the second is a lower-case letter."""
    second = F.substring(c, 2, 1)
    is_lower = (second == F.lower(second)) & (second != F.upper(second))
    return F.when(is_lower, F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))).otherwise(c)


def join_context(parts: Column) -> Column:
    """Non-empty parts joined by '. ', or by ' ' after a part that ends in a stop of its own."""
    stop = r"[.:;?!»\"']$"
    kept = F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    step = lambda acc, p: F.when(acc == "", p).when(acc.rlike(stop), F.concat(acc, F.lit(" "), p)).otherwise(F.concat(acc, F.lit(". "), p))
    return F.aggregate(kept, F.lit(""), step)


def contains_term(haystack: Column, needle: Column) -> Column:
    """needle in haystack with word boundaries at those of its ends that are word characters."""
    alnum = r"[\p{L}\p{N}]"
    start = F.when(F.left(needle, F.lit(1)).rlike(alnum), F.lit(r"(?<!\w)")).otherwise(F.lit(""))
    end = F.when(F.right(needle, F.lit(1)).rlike(alnum), F.lit(r"(?!\w)")).otherwise(F.lit(""))
    quoted = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    # a pattern that looks behind is tried at every place: it is asked only where the needle occurs at all
    return F.when(needle == "", F.lit(False)).when(~F.contains(haystack, needle), F.lit(False)).otherwise(F.rlike(haystack, F.concat(F.lit(r"(?U)"), start, F.lit(r"\Q"), quoted, F.lit(r"\E"), end)))


def is_table_class(c: Column) -> Column:
    return (c == "cabeza_tabla") | c.startswith("cuerpo_tabla_")


def has_body(classes: Column) -> Column:
    """Some paragraph class is no structural label."""
    return F.exists(classes, lambda c: ~c.isin(*STRUCTURAL))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """{name} places of a template filled in one pass: values are never looked into again."""
    import re

    parts = re.split(r"(\{[a-z_]+\})", template)
    return F.concat(*[values[p[1:-1]] if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in parts])


def correctness_score(label: Column) -> Column:
    return (
        F.when(label == "correct", 1.0).when(label == "partial", 0.5).when(label == "incorrect", 0.0)
        .otherwise(F.when(label.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("double")))
    )


def correctness_label(score: Column) -> Column:
    return F.when(score >= 0.75, "correct").when(score >= 0.25, "partial").when(score.isNotNull(), "incorrect")


def abstention_outcome(answered: Column, answerable: Column) -> Column:
    return (
        F.when(answered & answerable, "answered").when(answered, "false_answer")
        .when(answerable, "over_abstention").otherwise("correct_abstention")
    )


def abstention_point(answered: Column, asked_model: Column) -> Column:
    """Where it was decided: answered, by the model, or before it was asked."""
    return F.when(answered, "answered").when(asked_model, "llm_decided").otherwise("pre_llm")


def faithfulness_score(supported: Column) -> Column:
    """Share of true values of an array<boolean>; null for none."""
    return F.when(F.size(supported) > 0, F.size(F.filter(supported, lambda x: x)) / F.greatest(F.size(supported), F.lit(1)))


def is_faithful(score: Column, threshold: float) -> Column:
    """score >= threshold; null stays null."""
    return score >= threshold


def coded(code: Column, label: Column) -> Column:
    """struct<code, label> of a coded element; null if it is absent, which a null label stands for."""
    return F.when(label.isNotNull(), F.struct(code.alias("code"), clean_text(label).alias("label")))


def fill(template: str, **values: Column) -> Column:
    """The placeholders {name} of a model's template replaced one after the other, a value's own braces included."""
    made = F.lit(template)
    for name, value in values.items():
        made = F.replace(made, F.lit("{" + name + "}"), value)
    return made


def token_profile(n: Column, limit: Column) -> Column:
    """struct<n_tokens, truncated, margin, excess> of a text of n tokens against a limit."""
    return F.struct(n.alias("n_tokens"), (n > limit).alias("truncated"), (limit - n).alias("margin"), F.greatest(F.lit(0), n - limit).alias("excess"))


def effective_limit(declared: Column, tokenizer: Column) -> Column:
    """struct<limit, origin>: the tokenizer's limit if it is a sensible number (1 to 100000), else the declared one."""
    sensible = tokenizer.isNotNull() & (tokenizer > 0) & (tokenizer <= 100_000)
    return F.struct(F.when(sensible, tokenizer).otherwise(declared).alias("limit"), F.when(sensible, "tokenizer").otherwise("declared").alias("origin"))


def retrieval_text(text: Column, short_title: Column, hierarchy: Column, heading: Column) -> Column:
    """What is indexed of a chunk: short title, hierarchy, heading and text; a heading with which the text begins goes."""
    body = clean_text(text)
    head = clean_text(heading)
    shown = F.when((head != "") & body.startswith(head), F.lit("")).otherwise(head)
    return join_context(F.concat(F.array(clean_text(short_title)), F.transform(hierarchy, clean_text), F.array(shown, body)))


def artificial_stops(c: Column) -> Column:
    """Two full stops that are no part of an ellipsis."""
    return c.rlike(r"(?<!\.)\.\.(?!\.)")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and of digits with inner separators; repeats and order kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\d+(?:[.,/]\d+)*|[a-záéíóúüñçàèìòùâêîôûäöß]+"), F.lit(0))
