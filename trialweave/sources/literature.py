"""Literature: article XML, full texts, cleaning, queries, and the drug dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NO_ABSTRACT = "No abstract available"
FILTERS = "(fha[Filter]) AND (casereports[Filter]) AND (humans[Filter]) AND (english[Filter])"  # fixed value of the service

ARTICLE = """
MedlineCitation struct<PMID:string, Article:struct<
  ArticleTitle:string, Abstract:struct<AbstractText:array<string>>,
  AuthorList:struct<Author:array<struct<LastName:string, ForeName:string>>>,
  PublicationTypeList:struct<PublicationType:array<string>>,
  Journal:struct<JournalIssue:struct<PubDate:struct<Year:string, Month:string, Day:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string, _VALUE:string>>>>
"""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, authors, date, pmc_id and types of every article that has an id and a title."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path)
    a, issue = "MedlineCitation.Article", "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    ids = F.coalesce("PubmedData.ArticleIdList.ArticleId", F.array())
    name = lambda p: F.trim(F.concat_ws(" ", p["ForeName"], p["LastName"]))
    part = lambda n: F.coalesce(F.col(f"{issue}.{n}"), F.lit(""))
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"),
        F.coalesce(F.get(F.col(f"{a}.Abstract.AbstractText"), F.lit(0)), F.lit(NO_ABSTRACT)).alias("abstract"),
        F.array_join(F.transform(F.coalesce(f"{a}.AuthorList.Author", F.array()), name), ", ").alias("authors"),
        F.concat_ws("-", part("Year"), part("Month"), part("Day")).alias("date"),
        F.get(F.filter(ids, lambda x: x["_IdType"] == "pmc"), F.lit(0))["_VALUE"].alias("pmc_id"),
        F.col(f"{a}.PublicationTypeList.PublicationType").alias("types"),
    ).where("pmid is not null and title is not null")


def is_case_report(types: Column) -> Column:
    return F.coalesce(F.exists(types, lambda t: F.lower(t) == "case reports"), F.lit(False))


def tidy(text: Column) -> Column:
    """Runs of quotes as one, trimmed; blank is NULL."""
    return F.nullif(F.trim(F.regexp_replace(text, '"{2,}', '"')), F.lit(""))


def cleaned(articles: DataFrame) -> DataFrame:
    """Articles with text to report: full text, else title and abstract; rows with neither go."""
    have = set(articles.columns)
    df = articles
    for name in ("title", "abstract", "full_text", "authors", "pmc_id"):
        df = df.withColumn(name, tidy(F.col(name)) if name in have else F.lit(None).cast("string"))
    pmc = F.upper("pmc_id")
    df = df.withColumn("authors", F.regexp_replace("authors", r"\s{2,}", " ")).withColumn("pmc_id", F.when(~pmc.isin("NAN", "NONE"), pmc))
    empty = F.lower(F.coalesce("abstract", F.lit(""))).isin("", NO_ABSTRACT.lower())
    df = df.where(F.col("full_text").isNotNull() | ~empty)
    text = F.coalesce("full_text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit(""))))
    return df.withColumn("report", text).drop("full_text")


def search_query(condition: Column, terms: Column) -> Column:
    """Condition and any of the lower-cased terms, sorted so that equal sets make equal queries."""
    names = F.array_sort(F.array_distinct(F.transform(terms, lambda t: F.lower(t))))
    return F.concat(condition, F.lit(" AND ("), F.array_join(names, " OR "), F.lit(f") AND ({FILTERS})"))


def query_fan_out(queries: DataFrame) -> DataFrame:
    """Every query once, with the trials that share it."""
    return queries.groupBy("query").agg(F.array_sort(F.collect_set("nct_id")).alias("nct_ids"))


def with_full_text(articles: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Articles with the full text of their PMC id where there is one."""
    return articles.join(full_texts.select("pmc_id", "full_text"), "pmc_id", "left")


def full_text_of(xml: str | None) -> str | None:
    """Title, abstract, body and back matter as headed paragraphs; None for what is no XML."""
    if not xml:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None

    def section(node) -> list[str]:
        out = []
        for child in node:
            if child.tag == "title":
                out.append("## " + " ".join("".join(child.itertext()).split()))
            elif child.tag == "p":
                out.append(" ".join("".join(child.itertext()).split()))
            elif child.tag == "sec":
                out += section(child)
        return out

    parts = []
    title = root.find(".//article-title")
    if title is not None:
        parts.append(" ".join("".join(title.itertext()).split()))
    for name in ("abstract", "body", "back"):
        node = root.find(f".//{name}")
        if node is not None:
            parts.append("\n\n".join(section(node)))
    return "\n\n".join(p for p in parts if p) or None


@F.pandas_udf(StringType())
def full_text_udf(xml: pd.Series) -> pd.Series:
    return xml.map(full_text_of)


DRUG = "name string, synonyms struct<synonym:array<string>>, products struct<product:array<struct<name:string>>>, `international-brands` struct<`international-brand`:array<struct<name:string>>>"


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """drug, alias: every name that a drug goes by, lower-cased and trimmed, its own among them."""
    raw = spark.read.format("xml").option("rowTag", "drug").schema(DRUG).load(path).where("name is not null")
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array("name"), F.coalesce("synonyms.synonym", none), F.coalesce("products.product.name", none),
        F.coalesce("international-brands.international-brand.name", none),
    )
    tidy_names = F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n.isNotNull() & (n != "")))
    return raw.select(F.lower(F.trim("name")).alias("drug"), F.explode(tidy_names).alias("alias"))


def aliases_of(drugs: DataFrame, names: DataFrame) -> DataFrame:
    """name, alias for every name that is an alias of a drug: all of that drug's aliases, the last drug winning."""
    one = drugs.groupBy("alias").agg(F.max("drug").alias("drug"))
    return names.join(one, F.lower(F.trim(names["name"])) == one["alias"]).select("name", "drug").join(drugs, "drug").select("name", "alias").distinct()


def alias_union(*sets: DataFrame) -> DataFrame:
    """name, alias over arm names, drug names and what a source calls them, each once."""
    out = sets[0].select("name", F.lower("alias").alias("alias"))
    for s in sets[1:]:
        out = out.union(s.select("name", F.lower("alias").alias("alias")))
    return out.distinct()


def cached_lookup(wanted: DataFrame, cache: DataFrame, key: str, fetch) -> DataFrame:
    """Cached rows for wanted keys, and fetched ones for the rest."""
    have = cache.join(wanted.select(key).distinct(), key, "left_semi")
    return have.unionByName(fetch(wanted.join(cache.select(key), key, "left_anti")), allowMissingColumns=True)


def prompt_text(template: str, values: dict[str, str], known: Sequence[str] = ()) -> str:
    """A template with {{ name }} filled in; names without a value stay as they are."""
    import re

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)
