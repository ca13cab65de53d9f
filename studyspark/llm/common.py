"""Helpers shared by the operators: table access, written intermediate tables, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() and bytes.lower() of
#: Python follow exactly this rule (and lower A-Z only).
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="studyspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """(file system, path) behind a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.mkdirs(folder)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh name under the application's own folder, which goes when the application ends."""
    own = f"{shared_dir(spark)}/studyspark-{spark.sparkContext.applicationId}"
    fs, path = _folder(spark, own)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again; ``codec``: of the files.

    Whoever knows that nothing reads the table any more calls ``removed``; what a result
    still reads stays until the application ends."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            fs, path = _folder(df.sparkSession, f)
            fs.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table made by ``written``."""
    total = 0
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        fs, path = _folder(df.sparkSession, f)
        total += fs.getContentSummary(path).getLength()
    return total


def build_side(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A written table of unique keys as the build side of a shuffled hash join, if the share of a partition is
    ``most`` bytes at most; else Spark is free to sort, which spills."""
    share = stored_bytes(df) // max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.hint("shuffle_hash") if share <= most else df


def apart(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that stand beside those of ``df`` for a while: underscores are added until none clashes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, known: DataFrame, *, id_col: str, text_col: str, rows: int, weight: Column, most: int, by_label: bool) -> DataFrame:
    """(y, text) of at most ``rows`` labelled documents, of each label or of both, whose weights add up to ``most`` at most.

    ``known``: (id, y); ``weight``: an expression over ``text``.  Documents are taken in the order of a hash of
    id and text, among those that are there: labels of other documents change nothing.  One that no longer fits is
    passed over; rows equal in id and text are one.  How many there are says under which hash enough of them lie, so only keys and
    weights of little more than ``rows`` of each group reach the driver, and no task sees more than its share."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = known.withColumn("g", F.col("y") if by_label else F.lit(0))
    keyed = picked.select("id", F.xxhash64("id", "text").alias("k"), weight.cast("bigint").alias("n")).join(marked, "id")
    keyed = written(keyed.groupBy("k").agg(F.min("g").alias("g"), F.min("y").alias("y"), F.max("n").alias("n")).withColumn("h", F.xxhash64("k")), "labelled")
    wanted, under = rows + 8 * int(rows**0.5) + 64, F.lit(False)
    for r in keyed.groupBy("g").count().collect():
        share = (1 << 64) * wanted // max(r["count"], 1)
        under = under | ((F.col("g") == r.g) & (F.col("h") <= min(share - (1 << 63), (1 << 63) - 1)))
    left, seen, taken = {}, {}, []
    for r in sorted(keyed.where(under).collect(), key=lambda r: (r.h, r.k)):
        seen[r.g] = seen.get(r.g, 0) + 1
        if seen[r.g] <= rows and r.n <= left.setdefault(r.g, most):
            left[r.g] -= r.n
            taken.append((r.k, r.y))
    removed(keyed)
    chosen = docs.sparkSession.createDataFrame(taken, "k bigint, y int")
    return picked.withColumn("k", F.xxhash64("id", "text")).join(F.broadcast(chosen), "k").dropDuplicates(["k"]).select("y", "text")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches short enough that very long texts do not fill a worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes what is missing and keeps it up to a limit."""

    def __init__(self, make: Callable, limit: int = 600_000, longest: int = 48):
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= self._longest and len(self) < self._limit:
            self[key] = value
        return value
