"""Prompts as column expressions: templates filled from columns, and multiple-choice suffixes for every answer."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How questions, options and answers are laid out.
HEADER, QUESTION, OPTIONS, ANSWER = "\n\n**Multiple Choice Question(s):**", "\n\nQ: ", "\nOptions: ", "\nA: "


def label(n: int) -> str:
    """a, b, ... z, aa, ab, ... for 0, 1, ..."""
    out = ""
    while n >= 0:
        n, k = n // 26 - 1, n % 26
        out = chr(97 + k) + out
    return out


def rendered(template: str, values: Mapping[str, Column]) -> Column:
    """The template with {{ name }} filled from columns, a missing value as nothing; names without a column stay."""
    parts = re.split(r"(\{\{\s*\w+\s*\}\})", template)
    out = []
    for part in parts:
        name = re.fullmatch(r"\{\{\s*(\w+)\s*\}\}", part)
        out.append(F.coalesce(values[name[1]].cast("string"), F.lit("")) if name and name[1] in values else F.lit(part))
    return F.concat(*out)


def known_answers(names: Sequence[str]) -> Column:
    """The covariates that a row has an answer to, as `name: answer` lines; unknown ones are left out."""
    lines = [F.when(F.col(n).isNotNull() & (F.lower(F.col(n)) != "unknown"), F.concat(F.lit(f"{n}: "), F.col(n))) for n in names]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def choice_prompts(spark: SparkSession, questions: Mapping[str, str], options: Mapping[str, Sequence[str]]) -> DataFrame:
    """combo, suffix and a column for each question: all answers, the last question varying fastest, and the text that
    asks the questions and gives these answers. The lists are configuration, so the rows are few."""
    rows = []
    for k, chosen in enumerate(product(*options.values())):
        asked = [
            f"{QUESTION}{questions[name]}{OPTIONS}" + "".join(f"{label(j)}) {o} " for j, o in enumerate(options[name])) + f"{ANSWER}{answer}"
            for name, answer in zip(options, chosen, strict=True)
        ]
        rows.append((k, HEADER + "".join(asked), *chosen))
    return spark.createDataFrame(rows, ", ".join(["combo long, suffix string", *[f"`{n}` string" for n in options]]))


def scoring_requests(reports: DataFrame, prompt: Column, choices: DataFrame, key: str) -> DataFrame:
    """key, combo and the text to score, for every report and each of the few answers of `choices`."""
    few = F.array(*[F.struct(F.lit(r.combo).alias("combo"), F.lit(r.suffix).alias("suffix")) for r in choices.orderBy("combo").collect()])
    return reports.select(key, prompt.alias("_p"), F.explode(few).alias("_c")).select(key, "_c.combo", F.concat("_p", "_c.suffix").alias("text"))


def token_estimate(text: Column, max_tokens: int, n: int = 1, characters: float = 4.0) -> Column:
    """Tokens of a request: those of the prompt by its length, and all that n answers may have."""
    return (F.ceil(F.char_length(text) / characters) + max_tokens * n).cast("long")
