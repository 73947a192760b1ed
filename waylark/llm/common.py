"""Helpers of the operators: tables, shared files, word patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.session import new_shared_path

# A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
# Rows of one Arrow batch. Texts are of any length, so the batches are kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Lets Python workers receive `BATCH_ROWS` rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    """The width of a shuffle that the session was set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores, such that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns, never null; rows that are equal in them share the key."""
    seen = [F.col(c) for c in columns]
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in seen])
    return [F.xxhash64(marks, *seen), F.xxhash64(F.lit("second"), *seen[::-1], marks)]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as the cluster's file system names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, as a URI that tasks can open."""
    folder = qualified(spark, new_shared_path(spark, label))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return folder


def drop_shared(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table of this run that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def chosen_rows(docs: DataFrame, key: tuple[str, str], chosen: DataFrame) -> DataFrame:
    """The rows of docs whose `row_key` of all columns is in `chosen`, each `copies` times.

    chosen: the two key columns (unique), n (rows of docs with that key), copies. Rows
    that are equal in all columns count as one here. Only keys have been kept beside
    docs, so it is read again; its text is shuffled once by the key, or not at all if
    Spark broadcasts the chosen keys.
    """
    chosen, _ = stored(chosen, "chosen")
    keyed = docs.withColumns(dict(zip(key, row_key(*docs.columns), strict=True)))
    n, copies = unused(keyed, "rows_of_key"), unused(keyed, "copies_of_row")
    wanted = chosen.select(*key, F.col("n").alias(n), F.col("copies").alias(copies))
    found = keyed.join(wanted, list(key))
    if not chosen.where("n > 1").isEmpty():
        found = found.where(F.col(n) == 1).unionByName(found.where(F.col(n) > 1).dropDuplicates(list(key)))
    if not chosen.where("copies > 1").isEmpty():
        found = found.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return found.select(*docs.columns)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of all batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batched(schema: pa.Schema, rows: Iterator[tuple], size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(schema, held)
            held = []
    if held:
        yield batch_of(schema, held)
