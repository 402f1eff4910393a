"""Forum archives: compressed NDJSON in, partitioned Parquet out, and pruned scans of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trialweave.functions import text as T

#: Numbers are read as text and cast, since archives quote them now and then; unknown fields are ignored.
RAW = S.StructType([S.StructField(n, S.StringType()) for n in ("id", "link_id", "created_utc", "subreddit", "title", "selftext", "body", "author", "score")])


def read_archives(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """Typed records of NDJSON files, plain or compressed, in folders at any depth; lines that cannot be read are dropped.

    A compressed file is one task; what follows is dealt out anew by its partitioning keys.
    """
    raw = spark.read.schema(RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mode", "DROPMALFORMED").json(paths)
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"created_utc": F.col("created_utc").try_cast("double").cast("long"), "score": F.col("score").try_cast("double")})


def filtered(records: DataFrame) -> DataFrame:
    """Records whose post or comment passes the rules, with content_type and bucket."""
    kind = T.content_type(F.col("selftext"), F.col("body"), F.col("author"))
    return records.withColumn("content_type", kind).where(F.col("content_type") != "unknown").withColumn("bucket", T.bucket(F.col("subreddit")))


def write_partitions(records: DataFrame, path: str, by: Sequence[str] = ("content_type", "bucket"), mode: str = "overwrite", rows: int = 1_048_576) -> None:
    """Hive partitions, zstd, files of bounded length sorted by subreddit. Dynamic overwrite replaces the partitions that it has.

    A salt spreads a bucket that holds much of the rows over several tasks.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(8)) if "id" in records.columns else F.lit(0)
    dealt = records.withColumn("_salt", salt).repartition(*by, "_salt").drop("_salt")
    sort = [*by, *[c for c in ("subreddit",) if c in records.columns]]
    out = dealt.sortWithinPartitions(*sort).write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows)
    out.option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def subreddit_filter(subreddits: Sequence[str], spark: SparkSession) -> Column:
    """The predicate on subreddits and on the buckets that they are in: the latter prunes whole partitions."""
    names = spark.createDataFrame([(s,) for s in subreddits], "s string")
    buckets = [r[0] for r in names.select(T.bucket(F.col("s"))).distinct().collect()]
    return F.col("bucket").isin(*buckets) & F.col("subreddit").isin(*subreddits)


def scan(spark: SparkSession, path: str, subreddits: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Records of some subreddits; columns that do not exist are left out silently."""
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumn("bucket", F.lpad(F.col("bucket").cast("string"), 3, "0")) if dict(df.dtypes).get("bucket") != "string" else df
    if subreddits is not None:
        df = df.where(subreddit_filter(subreddits, spark))
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files without a done marker."""
    return files.join(manifest.select("path"), "path", "left_anti")


def input_digest(paths: DataFrame, column: str = "path") -> DataFrame:
    """A name for a set of inputs, the same in any order."""
    return paths.agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_set(column)), "").cast("binary")), 1, 12).alias("digest"))


def posts_and_comments(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of the thread join."""
    keyed = records.withColumn("author_key", T.author_key(F.col("author"))).withColumn("timestamp", F.col("created_utc"))
    posts = keyed.where("content_type = 'submissions'").select(F.col("id").alias("post_id"), "author_key", "subreddit", "title", "selftext", "score", "timestamp")
    comments = keyed.where("content_type = 'comments'").select("id", T.post_id(F.col("link_id")).alias("post_id"), "author_key", "subreddit", "body", "score", "timestamp")
    return posts, comments
