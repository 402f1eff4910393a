"""What the operators share: the shared folder, staged tables and byte-level word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns what separates words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` into blanks.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that continue a UTF-8 character; without them, bytes count code points.
CONTINUATION = bytes(range(0x80, 0xC0))
SAMPLE_BYTES = 96 << 20  # summed length of the whole texts that the driver takes to fit a model, at most


def plain_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return text.lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without one only a local session has one made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text; whatever other columns there are is not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def id_crc(doc_id) -> F.Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def fold_is(doc_id, modulus: int, remainder: int) -> F.Column:
    """True where the id's crc32 has that remainder; false for a null id."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(modulus)) == remainder, F.lit(False))


def one_thread() -> None:
    """Lets numpy's matrix products of this process use one thread: a task has one core, and waiting threads burn others.

    Workers are forked with numpy loaded, so its library is told by a call; one that has no such call stays as it is.
    """
    if _threads:
        return
    _threads.append(1)
    try:
        with open("/proc/self/maps") as maps:
            found = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_threads: list[int] = []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A batch's texts as bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.names.index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def own(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(make, schema)


def bounded_texts(df: DataFrame, ids: DataFrame, rows: int, size: int | None = None) -> list:
    """Rows of `df` (doc_id, text and others) of the given few ids, to fit a model on: whole texts of `size` bytes in all
    at most, each distinct row of an id and a text once, and `rows` of them at most.

    Which ones is settled by id, digest and length alone, in the order of a hash of the id, so two runs take the same. A
    text takes a sixteenth of the bytes at most: longer ones tell a model little for their size.
    """
    size = SAMPLE_BYTES if size is None else size
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in ("doc_id", "text")]
    digest = F.md5(F.concat_ws("\1", *rest, F.col("text").cast("string")).cast("binary"))
    mine = df.withColumns({"__d": digest, "__n": F.coalesce(F.octet_length("text"), F.lit(0))}).join(F.broadcast(ids), "doc_id")
    mine = mine.where(F.col("__n") <= size // 16)
    seen = mine.groupBy("doc_id", "__d").agg(F.max("__n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "__d").limit(rows).collect()
    place, total = {}, 0
    for r in seen:
        total += r.n
        if total > size:
            break
        place[r.doc_id, r["__d"]] = len(place)
    keys = df.sparkSession.createDataFrame(list(place), "doc_id long, __d string")
    got = mine.join(F.broadcast(keys), ["doc_id", "__d"]).dropDuplicates(["doc_id", "__d"]).drop("__n").toLocalIterator()
    return sorted(got, key=lambda r: place[r.doc_id, r["__d"]])


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids in the order of a hash of the id, one label for each id (the largest)."""
    got = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .toPandas()
    )
    spark = labels.sparkSession
    return spark.createDataFrame(got.astype({"doc_id": "int64", "label": "int32"}), "doc_id long, label int")
