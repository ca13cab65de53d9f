"""Stored state that is replaced as a whole: versions and one pointer.

A new state is written under a number of its own; then one small file that names the number is put in
place by a rename.  Readers follow the pointer, so they see the old state or the new one, never a
part, whatever breaks in between.  Numbers are taken by making their folder, which fails if another
writer has it; of two writers the one that renames last wins, and neither state is torn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _at(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path, name)


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the state that readers see; none before the first."""
    fs, _ = _files(spark, path)
    pointer = _at(spark, path, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """All numbers that have a folder, those of broken writes too."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def begin(spark: SparkSession, path: str) -> int:
    """A number that nobody has used."""
    fs, root = _files(spark, path)
    fs.mkdirs(root)
    number = max(versions(spark, path), default=0)
    while True:
        number += 1
        taken = _at(spark, path, f".v{number}.taken")
        try:
            fs.create(taken, False).close()  # fails where another writer was first
            return number
        except Exception:  # noqa: BLE001 - told apart by what is there now
            if not fs.exists(taken):
                raise


def commit(spark: SparkSession, path: str, number: int, keep: int = 2) -> None:
    """Let readers see a written version; of the older ones the last ``keep`` - 1 stay for those who still read them."""
    fs, _ = _files(spark, path)
    temporary = _at(spark, path, f".{POINTER}.{number}")
    out = fs.create(temporary, True)
    out.write(str(number).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(temporary, _at(spark, path, POINTER), how)
    for old in [v for v in versions(spark, path) if v < number][: -(keep - 1) or None]:
        fs.delete(_at(spark, path, f"v{old}"), True)
        fs.delete(_at(spark, path, f".v{old}.taken"), False)


def write(df: DataFrame, path: str, keep: int = 2) -> int:
    """Replace the state; gives its number.  ``df`` may read the state that it replaces."""
    spark = df.sparkSession
    number = begin(spark, path)
    df.write.parquet(f"{path}/v{number}")
    commit(spark, path, number, keep)
    return number


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete state; without any, no rows."""
    number = version(spark, path)
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{number}")
