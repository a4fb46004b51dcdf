"""Context assembly and evidence selection: greedy folds over short ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_bounded(paragraphs: Column, first: Column, last: Column, budget: int) -> Column:
    """struct<lo, hi, size> (0-based places): from places first..last, add the next paragraph and then the one before, in
    turn, while the joined text (line feeds counted) stays within the budget; ends when neither fits."""
    n = F.size(paragraphs)
    size = F.aggregate(F.slice(paragraphs, first + 1, last - first + 1), F.lit(-1), lambda s, p: s + F.length(p) + 1)
    start = F.struct(first.cast("int").alias("lo"), last.cast("int").alias("hi"), size.alias("size"))

    def grow(acc: Column, _: Column) -> Column:
        after = F.length(F.get(paragraphs, acc["hi"] + 1)) + 1
        up = F.coalesce((acc["hi"] + 1 < n) & (acc["size"] + after <= budget), F.lit(False))
        mid = F.struct(acc["lo"].alias("lo"), F.when(up, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"), F.when(up, acc["size"] + after).otherwise(acc["size"]).alias("size"))
        before = F.length(F.get(paragraphs, mid["lo"] - 1)) + 1
        down = F.coalesce((mid["lo"] > 0) & (mid["size"] + before <= budget), F.lit(False))
        return F.struct(F.when(down, mid["lo"] - 1).otherwise(mid["lo"]).alias("lo"), mid["hi"].alias("hi"), F.when(down, mid["size"] + before).otherwise(mid["size"]).alias("size"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, grow)


def select_evidence(hits: DataFrame, max_evidences: int = 5, item_chars: int = 4000, total_chars: int = 12000) -> DataFrame:
    """(query_id, parent_id, rank, evidence_id, reason) of hits(query_id, parent_id, rank, text): the best hit of each
    parent, taken in rank order. One that is blank, too long for itself or for what is left of the total is passed over
    with a reason, and the next is tried; after max_evidences the rest has no row. A query's hits are a top-k list."""
    best = hits.groupBy("query_id", "parent_id").agg(F.min_by(F.struct("rank", "text"), "rank").alias("h"))
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("h.rank").alias("rank"), "parent_id", F.col("h.text").alias("text")))).alias("hits"))
    row = "array<struct<parent_id:string,rank:int,evidence_id:string,reason:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(row).alias("rows"))

    def step(acc: Column, h: Column) -> Column:
        size = F.length(h["text"])
        reason = (
            F.when(F.coalesce(F.trim(h["text"]), F.lit("")) == "", "empty_context").when(size > item_chars, "exceeds_evidence_context_budget")
            .when(acc["used"] + size > total_chars, "exceeds_total_context_budget")
        )
        taken = reason.isNull()
        made = F.struct(
            h["parent_id"].cast("string").alias("parent_id"), h["rank"].cast("int").alias("rank"),
            F.when(taken, F.concat(F.lit("E"), (acc["n"] + 1).cast("string"))).alias("evidence_id"), reason.alias("reason"),
        )
        after = F.struct((acc["n"] + taken.cast("int")).alias("n"), (acc["used"] + F.when(taken, size).otherwise(0)).alias("used"), F.concat(acc["rows"], F.array(made)).alias("rows"))
        return F.when(acc["n"] >= max_evidences, acc).otherwise(after)

    out = lists.select("query_id", F.explode(F.aggregate("hits", start, step, lambda acc: acc["rows"])).alias("r"))
    return out.select("query_id", "r.parent_id", "r.rank", "r.evidence_id", "r.reason")


#: Context strategies and reasons (fixed values).
K_ONLY, FULL, BOUNDED = "K_ONLY", "P_EXPAND_FULL", "P_EXPAND_BOUNDED"
ANCHOR_TOO_LONG, ANCHOR_TOO_LONG_TEXT = "anchor_exceeds_budget", "anchor_exceeds_budget_retrieved_text_fallback"


def anchor_orders(paragraphs: Column, start: Column, end: Column) -> Column:
    """Orders of array<struct<order, text>> between start and end; empty without an anchor."""
    inside = F.filter(paragraphs, lambda p: (p["order"] >= start) & (p["order"] <= end))
    return F.when(start.isNull() | end.isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.array_sort(inside), lambda p: p["order"].cast("int")))


def joined_text(paragraphs: Column, orders: Column) -> Column:
    """Texts of the orders that exist, in order, parted by line feeds."""
    kept = F.filter(F.array_sort(paragraphs), lambda p: F.array_contains(orders, p["order"]))
    return F.array_join(F.transform(kept, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def assemble(hits: DataFrame, strategy: str, budget: int = 8000) -> DataFrame:
    """hits plus context struct<text, orders, char_count, item_count, base_char_count, over_budget, fallback, failed>.

    hits hold paragraphs array<struct<order int, text string>>, start and end of the anchor (or null) and text, what was
    retrieved. K_ONLY gives the retrieved text, or else the anchor's paragraphs; P_EXPAND_FULL all paragraphs;
    P_EXPAND_BOUNDED the anchor's, and by turns the next and the one before while the joined text fits the budget. An
    anchor over the budget falls back to the retrieved text, if any. failed: bounded expansion without a paragraph in the
    anchor; the caller leaves such a hit out."""
    if strategy not in (K_ONLY, FULL, BOUNDED):
        raise ValueError(f"unknown strategy {strategy}")
    if budget <= 0:
        raise ValueError("the budget must be positive")
    rows = hits.withColumn("__p", F.array_sort(F.coalesce("paragraphs", F.array().cast("array<struct<order:int,text:string>>"))))
    rows = rows.withColumn("__a", anchor_orders(F.col("__p"), F.col("start"), F.col("end"))).withColumn("__t", F.coalesce("text", F.lit("")))
    p, a, t = F.col("__p"), F.col("__a"), F.col("__t")
    every = F.transform(p, lambda x: x["order"].cast("int"))
    rows = rows.withColumn("__anchored", joined_text(p, a)).withColumn("__base", F.when(t != "", t).otherwise(F.col("__anchored")))
    anchored, base = F.col("__anchored"), F.col("__base")
    none, no = F.lit(None).cast("string"), F.lit(False)
    if strategy == K_ONLY:
        made = [base, a, F.greatest(F.size(a), F.lit(1)), no, none, no]
    elif strategy == FULL:
        text = joined_text(p, every)
        made = [F.when(text != "", text).otherwise(base), every, F.size(p), no, none, no]
    else:
        # an anchor's orders are neighbours in the sorted paragraphs
        place = (F.array_position(every, F.get(a, F.lit(0))) - 1).cast("int")
        texts = F.transform(p, lambda x: F.coalesce(x["text"], F.lit("")))
        grown = expand_bounded(texts, place, place + F.size(a) - 1, budget)
        rows = rows.withColumn("__g", F.when((F.size(a) > 0) & (F.length(anchored) <= budget), grown))
        g, too_long = F.col("__g"), F.length(anchored) > budget
        orders = F.when(g.isNull(), a).otherwise(F.slice(every, g["lo"] + 1, g["hi"] - g["lo"] + 1))
        wide = F.array_join(F.slice(texts, g["lo"] + 1, g["hi"] - g["lo"] + 1), "\n")
        text = F.when(too_long, F.when(t != "", t).otherwise(anchored)).otherwise(F.when(wide != "", wide).otherwise(base))
        fallback = F.when(too_long, F.when(t != "", ANCHOR_TOO_LONG_TEXT).otherwise(ANCHOR_TOO_LONG))
        made = [text, orders, F.size(orders), too_long & (F.length(text) > budget), fallback, F.size(a) == 0]
    names = ("text", "orders", "item_count", "over_budget", "fallback", "failed")
    rows = rows.withColumn("__m", F.struct(*[c.alias(n) for c, n in zip(made, names)]))
    m = F.col("__m")
    context = F.struct(m["text"].alias("text"), m["orders"].alias("orders"), F.length(m["text"]).alias("char_count"), m["item_count"].alias("item_count"), F.length(base).alias("base_char_count"), m["over_budget"].alias("over_budget"), m["fallback"].alias("fallback"), m["failed"].alias("failed"))
    return rows.withColumn("context", context).select(*hits.columns, "context")


def deduped(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the best hit of each parent of a query, (query_id, duplicates)); equal ranks by row content are one."""
    kept = hits.groupBy("query_id", "parent_id").agg(F.min_by(F.struct(*[c for c in hits.columns if c not in ("query_id", "parent_id")]), "rank").alias("h")).select("query_id", "parent_id", "h.*")
    return kept, hits.groupBy("query_id").agg((F.count("*") - F.count_distinct("parent_id")).alias("duplicates"))


def build_evidences(hits: DataFrame, parents: DataFrame, strategy: str = BOUNDED, max_evidences: int = 5, item_chars: int = 4000, total_chars: int = 12000) -> DataFrame:
    """(query_id, parent_id, rank, evidence_id, reason, char_count, orders, text) of hits(query_id, parent_id, rank, start,
    end, text) over parents(parent_id, paragraphs): the best hit of each parent in rank order, its context assembled; one
    that cannot be used is passed over with its reason (parent_not_found, empty_context, exceeds_evidence_context_budget,
    exceeds_total_context_budget) and the next is tried. Texts are never cut. A query's hits are a top-k list."""
    if max_evidences <= 0 or total_chars <= 0:
        raise ValueError("limits must be positive")
    best, _ = deduped(hits)
    known = best.join(parents.select("parent_id", "paragraphs", F.lit(True).alias("__known")), "parent_id", "left")
    made = assemble(known, strategy, item_chars)
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("parent_id").cast("string").alias("parent_id"), F.coalesce("__known", F.lit(False)).alias("known"), F.col("context.failed").alias("failed"),
        F.col("context.text").alias("text"), F.col("context.char_count").alias("char_count"), F.col("context.over_budget").alias("over_budget"), F.col("context.orders").alias("orders"),
    )
    lists = made.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    row = "array<struct<parent_id:string,rank:int,evidence_id:string,reason:string,char_count:int,orders:array<int>,text:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast(row).alias("rows"))

    def step(acc: Column, h: Column) -> Column:
        reason = (
            F.when(~h["known"], "parent_not_found").when(h["failed"] | (F.trim(F.coalesce(h["text"], F.lit(""))) == ""), "empty_context").when(h["over_budget"], "exceeds_evidence_context_budget")
            .when(acc["used"] + h["char_count"] > total_chars, "exceeds_total_context_budget")
        )
        taken = reason.isNull()
        made = F.struct(
            h["parent_id"].alias("parent_id"), h["rank"].alias("rank"), F.when(taken, F.concat(F.lit("E"), (acc["n"] + 1).cast("string"))).alias("evidence_id"), reason.alias("reason"),
            F.when(h["known"] & ~h["failed"], h["char_count"]).alias("char_count"), F.when(taken, h["orders"]).alias("orders"), F.when(taken, h["text"]).alias("text"),
        )
        after = F.struct((acc["n"] + taken.cast("int")).alias("n"), (acc["used"] + F.when(taken, h["char_count"]).otherwise(0)).alias("used"), F.concat(acc["rows"], F.array(made)).alias("rows"))
        return F.when(acc["n"] >= max_evidences, acc).otherwise(after)

    return lists.select("query_id", F.inline(F.aggregate("hits", start, step, lambda acc: acc["rows"])))


def oracle_hits(gold: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits of a perfect retriever from gold(query_id, parent_id, relevance, orders array<int>): relevant parents by relevance,
    anchored on their evidence or else on their first paragraph. Parents that do not exist keep their rank and are left out."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "parent_id"))
    ranked = gold.where("relevance >= 1").withColumn("rank", place).join(parents.select("parent_id", "paragraphs"), "parent_id")
    own = F.array_sort(F.coalesce("orders", F.array().cast("array<int>")))
    first = F.array_min(F.transform("paragraphs", lambda p: p["order"].cast("int")))
    text = F.array_join(F.transform(F.array_sort("paragraphs"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return ranked.select("query_id", "parent_id", "rank", F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(first).alias("start"), F.when(F.size(own) > 0, F.element_at(own, -1)).otherwise(first).alias("end"), text.alias("text"))


def oracle_evidences(gold: DataFrame, parents: DataFrame, **options) -> DataFrame:
    """build_evidences over oracle_hits: what a generator would get from perfect retrieval."""
    return build_evidences(oracle_hits(gold, parents), parents, **options)


def hit_trace(hits: DataFrame, evidences: DataFrame) -> DataFrame:
    """hits plus selected: whether an evidence was made of this hit (by parent and rank)."""
    used = evidences.where("evidence_id is not null").select("query_id", F.col("parent_id").alias("__parent"), F.col("rank").alias("__rank"), F.lit(True).alias("__used"))
    named = hits.withColumn("__parent", F.col("parent_id").cast("string")).withColumn("__rank", F.col("rank"))
    return named.join(used, ["query_id", "__parent", "__rank"], "left").select(*hits.columns, F.coalesce("__used", F.lit(False)).alias("selected"))


def context_configs(strategies: tuple[str, ...] = (K_ONLY, FULL, BOUNDED), budgets: tuple[int, ...] = (4000, 8000), ks: tuple[int, ...] = (1, 3, 5, 8)) -> list[tuple[str, int | None, int]]:
    """(strategy, budget, k) of an ablation; the budget varies for bounded expansion only."""
    return [(s, b, k) for s in strategies for b in (budgets if s == BOUNDED else (None,)) for k in ks]


def context_ablation(hits: DataFrame, parents: DataFrame, configs: list[tuple[str, int | None, int]]) -> DataFrame:
    """(strategy, budget, k, query_id, parent_id, orders, char_count, item_count, base_char_count) of the first k parents of each
    query under every configuration. Each strategy and budget is assembled once, for the largest k; bounded expansion
    without an anchor gives what K_ONLY gives."""
    best, _ = deduped(hits)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "parent_id"))
    ranked = best.withColumn("__place", place).where(F.col("__place") <= max(k for _, _, k in configs)).join(parents.select("parent_id", "paragraphs"), "parent_id")
    out = None
    for strategy, budget in dict.fromkeys((s, b) for s, b, _ in configs):
        made = assemble(ranked, strategy, budget or 8000)
        if strategy == BOUNDED:
            plain = assemble(ranked, K_ONLY).where(F.size(anchor_orders(F.col("paragraphs"), F.col("start"), F.col("end"))) == 0)
            made = made.where("not context.failed").unionByName(plain)
        ks = [k for s, b, k in configs if (s, b) == (strategy, budget)]
        one = made.select(
            F.lit(strategy).alias("strategy"), F.lit(budget).cast("int").alias("budget"), F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("__place"))).alias("k"),
            "query_id", "parent_id", "context.orders", "context.char_count", "context.item_count", "context.base_char_count",
        )
        out = one if out is None else out.unionByName(one)
    return out
