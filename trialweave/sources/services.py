"""Requests to and answers of the services, with a fetcher that is passed in: nothing here opens a connection itself.

A fetcher takes (path, parameters) and gives (status, body).
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.sources.external import with_retries

log = logging.getLogger(__name__)
Fetch = Callable[[str, dict[str, str]], tuple[int, str]]

# Fixed values of the services.
PAGE_SIZE = 1000
COMPLETED, ACTIVE = "studyType:int,results:with,status:com", "studyType:int,results:without,status:act rec"
LONGEST_GET = 1800


def registry_pages(fetch: Fetch, active: bool = False) -> Iterator[dict]:
    """Pages of trials by their tokens, one after the other; the first page that is not there ends them."""
    asked = {"format": "json", "aggFilters": ACTIVE if active else COMPLETED, "countTotal": "true", "pageSize": str(PAGE_SIZE)}
    token = None
    while True:
        status, body = with_retries(lambda token=token: fetch("studies", asked | ({"pageToken": token} if token else {})))
        if status != 200:
            log.error("page %s: status %s", token, status)
            return
        page = json.loads(body)
        yield page
        token = page.get("nextPageToken")
        if not token:
            return


def save_trials(spark: SparkSession, pages: Iterator[dict], path: str) -> int:
    """Trials as lines of JSON below path, written page by page, so that the driver holds one; returns how many."""
    total = 0
    for page in pages:
        rows = [(json.dumps(x),) for x in page["studies"]]
        if rows:
            spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)
        total += len(rows)
    return total


def search_request(query: Column, retmax: int = 10_000) -> Column:
    """How a literature search is sent: method, term, retmax; long ones by POST."""
    return F.struct(F.when(F.char_length(query) > LONGEST_GET, "POST").otherwise("GET").alias("method"), query.alias("term"), F.lit(str(retmax)).alias("retmax"))


def search_answer(xml: Column) -> Column:
    """web_env and query_key of a search's answer; NULL where it has none."""
    text = lambda path: F.nullif(F.xpath_string(xml, F.lit(path)), F.lit(""))
    return F.struct(text("//WebEnv").alias("web_env"), text("//QueryKey").alias("query_key"))


def search(queries: DataFrame, fetch: Fetch, key: str = "query") -> DataFrame:
    """The queries with web_env and query_key; a failed search has neither."""
    import pandas as pd

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [with_retries(lambda q=q: fetch("esearch", {"db": "pubmed", "term": q, "usehistory": "y"})) for q in frame[key]]
            yield frame.assign(_xml=[body if status == 200 else None for status, body in got])

    kept = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema], "_xml string"])
    out = queries.mapInPandas(ask, kept).withColumn("_a", search_answer(F.coalesce("_xml", F.lit("<x/>"))))
    return out.select(*queries.columns, "_a.web_env", "_a.query_key")


def indexed_names(html: Column) -> Column:
    """Distinct names of the archives that an index page links to, in order: what stands before the first underscore of the
    file's name."""
    links = F.regexp_extract_all(html, F.lit(r"href=([^\n]*\.zst[^\n]*)"), F.lit(1))
    name = lambda x: F.element_at(F.split(F.get(F.split(x, "_"), F.lit(0)), "/"), -1)
    return F.array_distinct(F.transform(links, name))


def about(fetched: DataFrame, key: str = "subreddit") -> DataFrame:
    """Descriptions of forums, one for each; what failed is marked `error` and goes."""
    return fetched.where(F.col(key) != "error").dropDuplicates([key])


def top_posts(posts: DataFrame, by: str, order: list[Column], title: str, body: str, limit: int = 5, characters: int = 1000) -> DataFrame:
    """by, place and a snippet of the first posts of each key; ranks are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = posts.withColumn("place", rank).where(F.col("place") <= limit)
    snippet = F.concat(F.lit("**Title**: "), F.coalesce(title, F.lit("")), F.lit("\n**Post content**: "), F.substring(F.coalesce(body, F.lit("")), 1, characters))
    return first.select(by, "place", snippet.alias("snippet"))


def as_json(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """key and its rows as one JSON list, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("x"))))
    return rows.groupBy(key).agg(F.to_json(F.transform(ordered, lambda r: r.x)).alias("json"))
