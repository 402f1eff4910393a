"""External answers as a pluggable operator, and what filters and sums them up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trialweave.functions import values as V
from trialweave.functions.values import draw
from trialweave.operators.prompts import known_answers
from trialweave.operators.relational import resumed


class Extractor(Protocol):
    """Answers prompts; None for one that failed. Pickled to the workers, and asked there batch by batch."""

    def answer(self, prompts: list[str]) -> Iterable[dict | None]: ...


def validated_answer(answer: dict | None, fields: dict[str, Sequence[str] | type]) -> dict | None:
    """The answer with choices in their own spelling; None if a field is missing, unknown, extra or no finite number."""
    if answer is None or set(answer) != set(fields):
        return None
    out = {}
    for name, kind in fields.items():
        value = answer[name]
        if isinstance(kind, type):
            try:
                out[name] = kind(value)
            except (TypeError, ValueError):
                return None
            if kind is float and not abs(out[name]) < float("inf"):
                return None
        else:
            same = [k for k in kind if str(value).casefold() == k.casefold()]
            if not same:
                return None
            out[name] = same[0]
    return out


def extract(df: DataFrame, key: str, prompt: Column, extractor: Extractor, fields: dict, suffix: str = "", cached: DataFrame | None = None) -> DataFrame:
    """key and one column `<field><suffix>` for each field; rows whose answer fails are absent. Cached rows are not asked again."""
    todo = df if cached is None else resumed(df, cached, key)[0]
    kind = S.StructType([df.schema[key], *[S.StructField(f"{n}{suffix}", S.DoubleType() if t is float else S.StringType()) for n, t in fields.items()]])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row_key, got in zip(frame[key], extractor.answer(frame["_prompt"].tolist()), strict=True):
                good = validated_answer(got, fields)
                if good is not None:
                    rows.append((row_key, *[good[n] for n in fields]))
            yield pd.DataFrame(rows, columns=kind.names)

    new = todo.select(key, prompt.alias("_prompt")).mapInPandas(ask, kind)
    return new if cached is None else resumed(df, cached, key, new)[1]


def stage(df: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    return df.join(answers, key)


# --- filters ----------------------------------------------------------------------------------------------------------


def relevant(df: DataFrame, column: str = "is_relevant") -> DataFrame:
    return df.where(F.lower(column) == "yes")


def treatment_outcome_known(df: DataFrame, arms: Sequence[str], treatment: str = "treatment_taken_filter", outcome: str = "outcome_category_filter") -> DataFrame:
    missing = {treatment, outcome} - set(df.columns)
    if missing:
        raise ValueError(f"missing: {', '.join(sorted(missing))}")
    return df.where(F.col(treatment).isin(*arms) & F.col(outcome).isin("Yes", "No"))


def meets_inclusion(df: DataFrame, column: str = "meets_inclusion_criteria") -> DataFrame:
    return df.where(F.lower(column).isin("yes", "unknown"))


def outcome_verdict(outcome: Column, basis: Column, bounds: tuple[float, float] | None = None, wanted_basis: str | None = None) -> Column:
    """keep, or the first reason against a sampled outcome: no number, another basis, out of bounds (both ends are in)."""
    value = outcome.try_cast("double")
    out = F.when(value.isNull() | ~V.is_finite(value), "not_numeric")
    if wanted_basis is not None:
        out = out.when(~basis.eqNullSafe(F.lit(wanted_basis)), "other_basis")
    if bounds is not None:
        out = out.when(~value.between(*bounds), "out_of_bounds")
    return out.otherwise("keep")


def owned(records: DataFrame, answers: DataFrame, key: str, source: str = "forum") -> DataFrame:
    """Records whose treatment is the author's own: posts always, comments if the answer for this record says so."""
    if source != "forum":
        return records
    got = records.join(answers.select(key, F.col("ownership").alias("_said")), key, "left")
    verdict = F.when(F.col("report_type") == "submission", "Yes").otherwise(F.coalesce("_said", F.lit("Unclear")))
    return got.withColumn("ownership", verdict).where(F.col("ownership") == "Yes").drop("_said")


# --- votes and conditionals -------------------------------------------------------------------------------------------


def vote_requests(df: DataFrame, votes: int = 25) -> DataFrame:
    """Each row as many times as it is voted on, numbered from 0."""
    return df.withColumn("vote", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))))


def vote_fractions(votes: DataFrame, key: str, vote: str, seed: int = 0) -> DataFrame:
    """key, n_votes, inclusion_probs = [P(no), P(yes)] over the votes that there are, and a label drawn by a hash."""
    got = votes.where(F.col(vote).isNotNull()).groupBy(key).agg(F.count("*").alias("n_votes"), F.avg((F.lower(vote) == "yes").cast("double")).alias("p"))
    label = F.when(draw(F.lit(seed), key) < F.col("p"), "Yes").otherwise("No")
    return got.select(key, "n_votes", F.array(1 - F.col("p"), F.col("p")).alias("inclusion_probs"), label.alias("label"))


def conditional_probabilities(scores: DataFrame, key: str, combo: str = "combo", score: str = "score", length: str | None = None) -> DataFrame:
    """key, probs: softmax over the answers' summed log-probabilities, by length where asked, in the answers' order.

    Answers are few and fixed in number, so those of one row meet in an array. A row with an answer missing is left out.
    """
    value = F.col(score) / F.col(length) if length else F.col(score)
    n = scores.agg(F.count_distinct(combo)).first()[0]
    rows = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(combo).alias("c"), value.alias("v")))).alias("_s")).where(F.size("_s") == n)
    return rows.select(key, V.softmax(F.transform("_s", lambda x: x.v)).alias("probs"))


def usage(calls: DataFrame) -> DataFrame:
    """Tokens and cost by stage and in all."""
    from trialweave.operators.relational import totals

    return totals(calls, "stage", "input_tokens", "output_tokens", "cost")


def chained(df: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[dict]]:
    """Stages in order, with the rows and seconds of each; stops at the first that leaves nothing."""
    import time

    log = []
    for name, run in stages:
        began = time.monotonic()
        try:
            df = run(df)
            n = df.count()
        except Exception as error:
            raise RuntimeError(f"stage {name} failed") from error
        log.append({"stage": name, "rows": n, "seconds": time.monotonic() - began})
        if not n:
            break
    return df, log


# --- answers as text, and the stages ----------------------------------------------------------------------------------


class JsonExtractor:
    """An extractor around a model that answers in text: JSON objects, with or without a fence around them."""

    def __init__(self, complete: Callable[[list[str]], Iterable[str | None]]):
        self.complete = complete

    def answer(self, prompts: list[str]) -> list[dict | None]:
        return [parsed(text) for text in self.complete(prompts)]


def parsed(text: str | None) -> dict | None:
    """The first JSON object of an answer; None where there is none."""
    import json

    start = (text or "").find("{")
    if start < 0:
        return None
    try:
        out = json.JSONDecoder().raw_decode(text[start:])[0]
    except json.JSONDecodeError:
        return None
    return out if isinstance(out, dict) else None


def keyword_lists(requests: DataFrame, keyword: str, prompt: Column, extractor: Extractor, field: str = "names", known: DataFrame | None = None) -> DataFrame:
    """keyword, names: a list for each keyword, asked once for it; known ones are kept, and what fails has an empty list."""
    todo = requests.withColumn("_p", prompt).groupBy(keyword).agg(F.min("_p").alias("_p"))
    if known is not None:
        todo = todo.join(known.select(keyword), keyword, "left_anti")
    kind = S.StructType([requests.schema[keyword], S.StructField("names", S.ArrayType(S.StringType()))])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = list(extractor.answer(frame["_p"].tolist()))
            lists = [[str(x) for x in a[field]] if a and isinstance(a.get(field), list) else [] for a in got]
            yield pd.DataFrame({keyword: frame[keyword], "names": lists})

    new = todo.mapInPandas(ask, kind)
    return new if known is None else known.select(keyword, "names").unionByName(new)


def condition_forums(conditions: DataFrame, found: DataFrame, extractor: Extractor, known: DataFrame | None = None) -> DataFrame:
    """condition, names: the forums that are relevant to each condition, from those that a search has found (`posts`, as
    JSON). Conditions without any found are not asked."""
    asked = conditions.select("condition").distinct().join(found, "condition")
    return keyword_lists(asked, "condition", F.concat(F.lit("Which forums discuss "), "condition", F.lit("?\n"), "posts"), extractor, known=known)


def synonyms(arms: DataFrame, extractor: Extractor, known: DataFrame | None = None) -> DataFrame:
    """keyword, names: other names of each treatment, asked once for each."""
    return keyword_lists(arms, "keyword", F.concat(F.lit("Other names of "), "keyword", F.lit(": "), F.coalesce("description", F.lit(""))), extractor, known=known)


@dataclass
class Stages:
    """The extraction stages of one outcome, each DataFrame in and out: `key` and `report` and whatever came before.

    covariates: name to answers; arms: names of the treatments.
    """

    extractor: Extractor
    key: str
    outcome: str
    arms: Sequence[str]
    covariates: dict[str, Sequence[str]]
    votes: int = 25

    def _ask(self, df: DataFrame, kind: str, fields: dict, more: Column | None = None, suffix: str = "") -> DataFrame:
        prompt = F.concat(F.lit(f"{kind}\n{self.outcome}\n"), F.coalesce(more, F.lit("")) if more is not None else F.lit(""), F.lit("\n"), F.coalesce("report", F.lit("")))
        return stage(df, extract(df, self.key, prompt, self.extractor, fields, suffix), self.key)

    def relevance(self, df: DataFrame) -> DataFrame:
        return relevant(self._ask(df, "relevance", {"is_relevant": ("Yes", "No")}))

    def treatment_outcome(self, df: DataFrame) -> DataFrame:
        got = self._ask(df, "ty_filter", {"treatment_taken": [*self.arms, "Unknown"], "outcome_category": ("Yes", "No", "Unknown")}, suffix="_filter")
        return treatment_outcome_known(got, self.arms)

    def knowns(self, df: DataFrame) -> DataFrame:
        return self._ask(df, "knowns", {c: [*o, "Unknown"] for c, o in self.covariates.items()})

    def imputations(self, df: DataFrame) -> DataFrame:
        return self._ask(df, "imputations", {c: list(o) for c, o in self.covariates.items()}, known_answers(list(self.covariates)), "_imputed")

    def sample_treatment_outcome(self, df: DataFrame) -> DataFrame:
        given = known_answers([f"{c}_imputed" for c in self.covariates])
        return self._ask(df, "sample_ty", {"treatment_taken": list(self.arms), "outcome_category": ("Yes", "No")}, given, "_sampled")

    def inclusion(self, df: DataFrame) -> DataFrame:
        """Rows with inclusion_probs, from several votes on each; a row without any vote goes."""
        votes = vote_requests(df.select(self.key, "report"), self.votes).withColumn("_vote_key", F.concat_ws("#", self.key, "vote"))
        prompt = F.concat(F.lit(f"inclusion\n{self.outcome}\n"), F.col("vote").cast("string"), F.lit("\n"), F.coalesce("report", F.lit("")))
        said = extract(votes, "_vote_key", prompt, self.extractor, {"meets_inclusion_criteria": ("Yes", "No")})
        got = vote_fractions(votes.join(said, "_vote_key"), self.key, "meets_inclusion_criteria")
        return df.join(got.select(self.key, "inclusion_probs"), self.key)

    def all(self) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
        return [
            ("relevance", self.relevance), ("ty_filter", self.treatment_outcome), ("knowns", self.knowns),
            ("imputations", self.imputations), ("sample_ty", self.sample_treatment_outcome), ("inclusion", self.inclusion),
        ]
