"""Quality rules: text statistics and a learned decision list, in Spark expressions only."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import discard, materialize, sample_labels

#: Labelled rows whose statistics the driver learns from, a few numbers each.
TRAIN_ROWS = 4_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_RULES, MAX_CONDITIONS, CANDIDATES = 8, 3, 24
#: A rule is kept if at least this share of what it covers is of its class, on the growing and on the pruning rows.
MIN_PRECISION, MIN_COVER = 0.9, 5

_WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """Runs of characters other than blank and \\x09-\\x0D."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes of their words' hashes. Texts whose windows are all distinct end there. In the
    others the hashes are sorted with their places: a window equal to a neighbour repeats, and each repeated one, in order
    of place, adds the words by which it reaches beyond the last."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.transform(F.slice(h, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))

    def places(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda s, x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        mark = lambda s: F.transform(s, lambda x, k: F.when(equal(s, x, k - 1) | equal(s, x, k + 1), x["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.array_remove(_let(ranked, mark), F.lit(-1)))

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.size(at) - 1), lambda y, x: F.least(F.lit(3), y - x))
        return F.aggregate(steps, F.lit(3).cast("long"), lambda total, x: total + x)

    none = F.lit(0).cast("long")
    counted = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(_let(places(g), covered))
    return F.when(n < 4, none).otherwise(_let(windows, counted))


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, others, base statistics as in the contract, and shares that the learned rules use) for every row; null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *others, text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    stats = base.select(
        "doc_id",
        *others,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\n")).cast("long").alias("n_breaks"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_bangs") / words).alias("bangs_per_word"),
        (F.col("n_distinct") / words).alias("distinct_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / (F.col("n_breaks") + 1)).alias("dup_line_share"),
        (F.col("n_words") / (F.col("n_breaks") + 1)).alias("words_per_line"),
    )


#: What conditions are learned on.
FEATURES = ("mean_word", "symbols_per_word", "upper_share", "bangs_per_word", "distinct_share", "repeat_share", "dup_line_share", "words_per_line")

Condition = tuple[str, str, float]
Rule = tuple[tuple[Condition, ...], float]


def _holds(row: dict, condition: Condition) -> bool:
    name, sign, bound = condition
    return row[name] >= bound if sign == ">=" else row[name] < bound


def _covers(rule: tuple[Condition, ...], row: dict) -> bool:
    return all(_holds(row, c) for c in rule)


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """First-order information gain of a refinement."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _grow(rows: list[dict]) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MAX_CONDITIONS:
        bad0 = sum(not r["label"] for r in rows)
        good0 = len(rows) - bad0
        if not bad0 or not good0:
            break
        best = (1e-9, None)
        for name in FEATURES:
            values = sorted((r[name], r["label"]) for r in rows)
            below = [0, *accumulate(not y for _, y in values)]  # bad rows among the first k
            for bound in sorted({values[len(values) * i // CANDIDATES][0] for i in range(1, CANDIDATES)} | {v for v, y in values if not y}):
                k = bisect_left(values, (bound,))
                bad, good = bad0 - below[k], len(values) - k - (bad0 - below[k])
                best = max(best, (_gain(bad, good, bad0, good0), (name, ">=", bound)), (_gain(bad0 - bad, good0 - good, bad0, good0), (name, "<", bound)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [r for r in rows if _holds(r, best[1])]
    return rule


def _worth(rule: tuple[Condition, ...], rows: list[dict]) -> tuple[float, int, int]:
    bad = sum(_covers(rule, r) and not r["label"] for r in rows)
    good = sum(_covers(rule, r) and bool(r["label"]) for r in rows)
    return (bad - good) / max(1, bad + good), bad, good


def _prune(rule: tuple[Condition, ...], rows: list[dict]) -> tuple[Condition, ...]:
    """Drops last conditions while that makes the rule no worse on rows it was not grown on."""
    best, worth = rule, _worth(rule, rows)[0]
    for k in range(len(rule) - 1, 0, -1):
        now = _worth(rule[:k], rows)[0]
        if now >= worth:
            best, worth = rule[:k], now
    return best


def learn_rules(rows: list[dict]) -> list[Rule]:
    """Sequential covering: grow a conjunction for label 0 on two thirds of the rows, prune it on the rest, keep it if
    it is precise on both, drop what it covers, go on. rows: the FEATURES and label 0/1. Order of rows decides ties."""
    grow, test = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(not r["label"] for r in grow):
        rule = _prune(_grow(grow), test)
        if not rule:
            break
        (_, bad, good), (_, bad_t, good_t) = _worth(rule, grow), _worth(rule, test)
        if bad < MIN_COVER or bad + bad_t < MIN_PRECISION * (bad + good + bad_t + good_t) or bad_t < MIN_PRECISION * (bad_t + good_t):
            break
        rules.append((rule, (bad + bad_t) / (bad + good + bad_t + good_t)))
        grow, test = [r for r in grow if not _covers(rule, r)], [r for r in test if not _covers(rule, r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE: the number of the first rule that holds, 0 if none does."""
    out = None
    for n, (conditions, _) in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, bound in conditions:
            test &= (F.col(name) >= bound) if sign == ">=" else (F.col(name) < bound)
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept) for every row.

    Rules are learned from at most `rows` labelled documents outside the held-out fold that pass the base checks; their
    statistics, not their texts, go to the driver. Null texts have no words and fail the base check; repeated rows are
    judged each; without labels every document that passes the base checks is kept; extra columns are ignored; an empty
    table gives an empty result."""
    picked = sample_labels(labels, "quality", rows)
    # stored first: else the base check would move below the join and run over all texts
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    known = materialize(known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")), "rule-texts")
    measured = statistics(known, "label").select("doc_id", "label", "base_failed", *FEATURES)
    found = sorted((r.asDict() for r in measured.collect() if not r["base_failed"]), key=lambda r: (r["doc_id"], r["mean_word"]))
    discard(known)
    rules = learn_rules(found)
    judged = statistics(docs).withColumn("rule", F.when(F.col("base_failed"), F.lit(None)).otherwise(verdict(rules)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", F.coalesce(F.col("rule") == 0, F.lit(False)).alias("kept"))
