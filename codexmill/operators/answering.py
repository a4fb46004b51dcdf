"""From a question to an answer: prompts, an injected model, validated citations, abstention, judges; profiles of models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions.text import render_template
from codexmill.operators.context import BOUNDED, FULL, K_ONLY, build_evidences, oracle_evidences
from codexmill.operators.generation import allowed_ids, ask, closed_book, enriched_citations, evidences_block, messages

#: Shape of a model's answer, reasons of abstention (fixed values).
ANSWER = "struct<answered:boolean,answer:string,citations:array<string>,reason:string>"
NO_HITS, NO_EVIDENCE, INVALID = "no_hits", "no_evidence", "invalid_citations"


@dataclass(frozen=True)
class GenerationConfig:
    """Limits of an answer run; they must be positive and the strategy known."""

    max_evidences: int = 5
    item_chars: int = 4000
    total_chars: int = 12000
    top_k: int = 10
    strategy: str = BOUNDED

    def __post_init__(self) -> None:
        for name in ("max_evidences", "item_chars", "total_chars", "top_k"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.strategy not in (K_ONLY, FULL, BOUNDED):
            raise ValueError(f"unknown strategy {self.strategy}")


@dataclass(frozen=True)
class ModelContract:
    """What is known of an encoder: revisions, limits, templates and the query profiles it allows, the default first."""

    alias: str
    model_id: str
    dim: int
    max_tokens: int
    revision: str | None = None
    tokenizer_revision: str | None = None
    document_template: str = "{text}"
    query_template: str = "{query}"
    default_task: str = ""
    profiles: tuple[str, ...] = field(default=())
    remote_code: bool = False
    remote_code_reviewed: bool = False

    def pinned(self) -> bool:
        """Model and tokenizer are fixed to commits of 40 digits."""
        return all(r is not None and len(r) == 40 and set(r) <= set("0123456789abcdef") for r in (self.revision, self.tokenizer_revision))

    def profile_ids(self) -> tuple[str, ...]:
        """The allowed profiles, each once, in order."""
        return tuple(dict.fromkeys(self.profiles))

    def resolve_profile(self, wanted: str | None = None) -> str | None:
        """The wanted profile if it is allowed, without a wish the first one; another raises."""
        allowed = self.profile_ids()
        if wanted is None:
            return allowed[0] if allowed else None
        if wanted not in allowed:
            raise ValueError(f"{wanted} is no profile of {self.alias}: {allowed}")
        return wanted


def incompatible_fields(contract: ModelContract, bundle: dict) -> list[str]:
    """Those of six fields in which a bundle's manifest is not what the contract says."""
    names = ("alias", "model_id", "dim", "revision", "tokenizer_revision", "document_template")
    return [n for n in names if bundle.get(n) != getattr(contract, n)]


def assert_compatible(contract: ModelContract, bundle: dict) -> None:
    if lost := incompatible_fields(contract, bundle):
        raise ValueError(f"the bundle does not fit {contract.alias}: {lost}")


def serialized_schema(schema: dict) -> str:
    """A JSON schema with sorted names."""
    return json.dumps(schema, sort_keys=True, ensure_ascii=False)


def _answers(prompts: DataFrame, evidences: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Validated answers: a reply that is no JSON of ANSWER is an error; cited ids must be among the evidences."""
    got = ask(prompts, model).withColumn("r", F.from_json("answer", ANSWER))
    listed = evidences.where("evidence_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "parent_id", F.col("parent_id").alias("label"), F.lit(None).cast("string").alias("url")))).alias("e"))
    both = got.join(listed, "query_id", "left")
    unread = F.col("error").isNull() & F.col("r.answered").isNull()
    cited = F.coalesce("r.citations", F.array().cast("array<string>"))
    known = F.forall(cited, lambda c: F.exists("e", lambda x: x["evidence_id"] == c)) & (F.size(cited) > 0)
    answered = F.coalesce(F.col("r.answered"), F.lit(False)) & F.coalesce(known, F.lit(False))
    return both.select(
        "query_id", F.when(unread, "invalid answer").otherwise(F.col("error")).alias("error"), answered.alias("answered"), F.when(answered, F.col("r.answer")).alias("text"), F.lit(True).alias("asked_model"),
        F.when(answered, enriched_citations(cited, F.col("e"))).alias("citations"),
        F.when(~answered & F.col("error").isNull() & ~unread, F.when(F.col("r.answered"), INVALID).otherwise(F.coalesce(F.col("r.reason"), F.lit("")))).alias("reason"),
    )


def answer(questions: DataFrame, hits: DataFrame, parents: DataFrame, model: Callable[[list[str]], list[str]], system: str, template: str, config: GenerationConfig = GenerationConfig()) -> tuple[DataFrame, DataFrame]:
    """(answers, evidences) of questions(query_id, query) over retrieved hits: evidences are selected, a prompt is made, the model
    is asked, its citations are checked. A question without hits, or without a usable evidence, abstains and is not asked;
    an answer that cites nothing known abstains; a failure of the model is that question's error alone."""
    found = build_evidences(hits, parents, config.strategy, config.max_evidences, config.item_chars, config.total_chars)
    return _run(questions, hits, found, model, system, template), found


def answer_with(questions: DataFrame, evidences: DataFrame, model: Callable[[list[str]], list[str]], system: str, template: str) -> DataFrame:
    """The same with given evidences (query_id, parent_id, rank, evidence_id, text)."""
    return _run(questions, evidences, evidences, model, system, template)


def answer_oracle(questions: DataFrame, gold: DataFrame, parents: DataFrame, model: Callable[[list[str]], list[str]], system: str, template: str, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """The same with the evidences of perfect retrieval."""
    return answer_with(questions, oracle_evidences(gold, parents, strategy=config.strategy, max_evidences=config.max_evidences, item_chars=config.item_chars, total_chars=config.total_chars), model, system, template)


def _run(questions: DataFrame, hits: DataFrame, evidences: DataFrame, model, system: str, template: str) -> DataFrame:
    shown = evidences.where("evidence_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", F.col("parent_id").alias("label"), "text"))).alias("ev"))
    asked = questions.join(shown, "query_id", "left").join(hits.select("query_id", F.lit(True).alias("__hit")).distinct(), "query_id", "left")
    user = render_template(template, {"question": F.col("query"), "evidences": evidences_block(F.col("ev")), "allowed_ids": allowed_ids(F.size("ev"))})
    ready = asked.where("ev is not null").select("query_id", F.to_json(messages(system, user)).alias("prompt"))
    none = F.when(F.col("__hit").isNull(), NO_HITS).otherwise(NO_EVIDENCE)
    silent = asked.where("ev is null").select("query_id", none.alias("reason"), F.lit(False).alias("answered"), F.lit(False).alias("asked_model"))
    return _answers(ready, evidences, model).unionByName(silent, allowMissingColumns=True)


def answer_closed_book(questions: DataFrame, model: Callable[[list[str]], list[str]], system: str) -> DataFrame:
    """(query_id, error, answered, text, reason) of questions asked without evidence."""
    got = ask(questions.select("query_id", F.to_json(closed_book(system, F.col("query"))).alias("prompt")), model).withColumn("r", F.from_json("answer", "struct<answered:boolean,answer:string,reason:string>"))
    unread = F.col("error").isNull() & F.col("r.answered").isNull()
    return got.select("query_id", F.when(unread, "invalid answer").otherwise(F.col("error")).alias("error"), F.coalesce("r.answered", F.lit(False)).alias("answered"), F.when(F.col("r.answered"), F.col("r.answer")).alias("text"), F.when(~F.col("r.answered"), F.col("r.reason")).alias("reason"))


def judge_faithfulness(answers: DataFrame, model: Callable[[list[str]], list[str]], template: str) -> DataFrame:
    """(query_id, claims array<boolean>, error): which claims of answers(query_id, text, evidences) the evidences support, by a model that replies {"claims": [{"supported": bool}]}."""
    prompts = answers.select("query_id", render_template(template, {"answer": F.col("text"), "evidences": F.col("evidences")}).alias("prompt"))
    got = ask(prompts, model).withColumn("r", F.from_json("answer", "struct<claims:array<struct<supported:boolean>>>"))
    return got.select("query_id", F.transform("r.claims", lambda c: c["supported"]).alias("claims"), F.when(F.col("error").isNull() & F.col("r.claims").isNull(), "invalid verdict").otherwise(F.col("error")).alias("error"))


def judge_correctness(answers: DataFrame, model: Callable[[list[str]], list[str]], template: str) -> DataFrame:
    """(query_id, verdict, error) of answers(query_id, text, reference): correct, partial or incorrect; anything else is an error."""
    prompts = answers.select("query_id", render_template(template, {"answer": F.col("text"), "reference": F.col("reference")}).alias("prompt"))
    got = ask(prompts, model).withColumn("v", F.from_json("answer", "struct<verdict:string>")["verdict"])
    known = F.coalesce(F.col("v").isin("correct", "partial", "incorrect"), F.lit(False))
    return got.select("query_id", F.when(known, F.col("v")).alias("verdict"), F.when(F.col("error").isNull() & ~known, "invalid verdict").otherwise(F.col("error")).alias("error"))
