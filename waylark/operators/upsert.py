"""Deduplication, upserts and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key in `order`, which should be a total order.

    `row_number() = 1` lets Spark put a group limit in front of the shuffle: each
    task sends at most one row per key, so a key that holds a third of the table
    costs no more than any other.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update_cols: list[str],
    now: Column,
    created_col: str | None = "created_at",
    updated_col: str | None = "updated_at",
    null_keys: bool = True,
) -> DataFrame:
    """Insert new keys; on a known key change only `update_cols`.

    `source` must be unique on `keys` (see `dedupe`), like `target`: then the
    full outer join hashes unique keys on both sides and cannot be skewed. Keys without
    nulls (`null_keys=False`) are compared as they are, which lets the join use a bucketing.
    """
    not_allowed = set(update_cols) - (set(target.columns) - {created_col, updated_col} - set(keys))
    if not_allowed:
        raise ValueError(f"cannot update {sorted(not_allowed)}")
    s = source.select(*[F.col(c).alias(f"_new_{c}") for c in source.columns], F.lit(True).alias("_in_src"))
    t = target.withColumn("_in_tgt", F.lit(True))
    same = lambda a, b: a.eqNullSafe(b) if null_keys else a == b
    joined = t.join(s, [same(t[k], s[f"_new_{k}"]) for k in keys], "full_outer")
    known, arriving = F.col("_in_tgt").isNotNull(), F.col("_in_src").isNotNull()

    out = []
    for name in target.columns:
        fresh = F.col(f"_new_{name}") if name in source.columns else F.lit(None)
        fresh = fresh.cast(target.schema[name].dataType)
        if name == updated_col:
            value = F.when(arriving, now).otherwise(F.col(name))
        elif name == created_col:
            value = F.when(known, F.col(name)).otherwise(now)
        elif name in update_cols:
            value = F.when(arriving, fresh).otherwise(F.col(name))
        else:
            value = F.when(known, F.col(name)).otherwise(fresh)
        out.append(value.cast(target.schema[name].dataType).alias(name))
    return joined.select(*out)


def insert_ignore(
    target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Append the source rows whose key is not in the target.

    Of source rows with one key the first in `order` is inserted; without an order, the
    first by all other columns.
    """
    by = order or [F.col(c) for c in source.columns if c not in keys]
    once = dedupe(source, keys, by) if by else source.dropDuplicates(keys)
    fresh = once.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def mark_processed(ledger: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Ledger plus one row per new id."""
    fresh = ids.select(key).distinct().withColumn("processed_at", now)
    return insert_ignore(ledger, fresh, [key])


def pending(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return df.join(ledger.select(key), key, "left_anti")


def pending_pairs(df: DataFrame, pair: list[str], done: Column | None = None) -> DataFrame:
    """Distinct pairs still to be processed."""
    todo = df if done is None else df.filter(~F.coalesce(done, F.lit(False)))
    return todo.select(*pair).distinct()


def distinct_codes(df: DataFrame, cols: list[str], name: str = "code") -> DataFrame:
    """Distinct values over several columns in one pass over df."""
    return (
        df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias(name))
        .filter(F.col(name).isNotNull())
        .distinct()
    )


def unknown_codes(df: DataFrame, cols: list[str], dim: DataFrame, dim_key: str, name: str = "code") -> DataFrame:
    """Codes used in df that the dimension does not hold."""
    known = dim.select(F.col(dim_key).alias(name))
    return distinct_codes(df, cols, name).join(known, name, "left_anti")


# --- keeping an upserted table on storage ------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder of our own, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def first_rows(source: DataFrame, schema, now: Column, created_col: str = "created_at", updated_col: str = "updated_at") -> DataFrame:
    """`upsert` into a table without rows."""
    value = lambda f: now if f.name in (created_col, updated_col) else F.col(f.name) if f.name in source.columns else F.lit(None)
    fields = source.sparkSession.createDataFrame([], schema).schema.fields
    return source.select(*[value(f).cast(f.dataType).alias(f.name) for f in fields])


def _in_partitions(stored: DataFrame, arrived: DataFrame, col: str) -> DataFrame:
    """Stored rows in the partitions of the arrived ones.

    The touched partitions are the small side of a semi join on the partition column;
    Spark prunes the stored files by them when the join runs.
    """
    touched = arrived.select(F.col(col).alias("_touched")).distinct()
    return stored.join(touched, stored[col].eqNullSafe(F.col("_touched")), "left_semi")


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: list[str],
    update_cols: list[str],
    now: Column,
    partition_col: str,
    staging_path: str,
    order: list[Column],
    schema,
) -> None:
    """Upsert `source` into the parquet table at `path`.

    Only the partitions that the source touches are read and replaced. The
    partition column must follow from the key (the journey date is part of the
    journey key), so an update never moves a row to another partition.

    The arriving rows and then the merged partitions are written in full below
    `staging_path`, which must be new for each batch; the latter are put in place by a dynamic partition overwrite. A run that died in between is
    repeated from the staged copy with the same result, so the step is safe to
    retry after losing executors or the driver. The first rows of a table have nothing to be
    merged with and are staged once.
    """
    merged_path, arrived_path = f"{staging_path}/merged", f"{staging_path}/arrived"
    staged = _exists(spark, f"{merged_path}/_SUCCESS")
    if not staged and not _exists(spark, path):
        first_rows(dedupe(source, keys, order), schema, now).write.mode("overwrite").parquet(merged_path)
    elif not staged:
        dedupe(source, keys, order).write.mode("overwrite").parquet(arrived_path)
        arrived = spark.read.parquet(arrived_path)
        target = _in_partitions(spark.read.schema(schema).parquet(path), arrived, partition_col)
        upsert(target, arrived, keys, update_cols, now).write.mode("overwrite").parquet(merged_path)
    (
        spark.read.schema(schema).parquet(merged_path)
        # AQE merges small partitions and splits a large one over several writers.
        .hint("rebalance", partition_col)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col).parquet(path)
    )


# --- a fact stored in buckets of its key -------------------------------------

# Rows of a table for each of its buckets, which one task sorts and merges.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int, least: int) -> int:
    """Buckets of a new table that is expected to hold so many rows, so that none outgrows a task."""
    return max(least, -(-rows // BUCKET_ROWS))


def bucketed_table(spark: SparkSession, name: str, path: str, schema, keys: list[str], partition_col: str,
                   buckets: int) -> DataFrame:
    """The catalog table `name` over the files at `path`, partitioned and, within partitions, in sorted
    buckets of the key; declared if the catalog does not have it.

    The partition column is none of the keys. Buckets must not change as long as the files stay. A catalog that forgets (one in memory)
    learns partitions that are already there.
    """
    if not spark.catalog.tableExists(name):
        fields = spark.createDataFrame([], schema).schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        key = ", ".join(f"`{k}`" for k in keys)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{partition_col}`) "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
        if _exists(spark, path):
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def merged_buckets(target: DataFrame, arrived: DataFrame, keys: list[str], update_cols: list[str], now: Column,
                   partition_col: str) -> DataFrame:
    """The touched partitions of a bucketed table with the arrived rows merged in.

    Only the arrived rows are shuffled, into the table's buckets; each bucket is merged
    where it is read. The values of touched partitions come to the driver, at most one
    for each partition of the table.
    """
    touched = [r[0] for r in arrived.select(partition_col).distinct().collect()]
    col = target[partition_col]
    inside = col.isin([v for v in touched if v is not None])
    read = target.where(inside | col.isNull() if None in touched else inside)
    return upsert(read, arrived, keys, update_cols, now, null_keys=False)


def upsert_bucketed(
    spark: SparkSession,
    name: str,
    source: DataFrame,
    keys: list[str],
    update_cols: list[str],
    now: Column,
    partition_col: str,
    staging_path: str,
    order: list[Column],
) -> None:
    """Upsert `source` into a table made by `bucketed_table`, without a shuffle of the table.

    The partition column must follow from the key, and no key may hold a null (an error).
    The arriving rows are staged below `staging_path`, new for each batch. The
    merged partitions replace the old ones when the job commits; a run that died is
    repeated from the staged rows and gives the same table, as a key that was already
    merged is only set to the same values again.
    """
    arrived_path = f"{staging_path}/arrived"
    if not _exists(spark, f"{arrived_path}/_SUCCESS"):
        dedupe(source, keys, order).write.mode("overwrite").parquet(arrived_path)
    arrived = spark.read.parquet(arrived_path)
    missing = [F.col(k).isNull() for k in keys]
    if not arrived.where(F.greatest(*missing) if len(missing) > 1 else missing[0]).isEmpty():
        raise ValueError(f"null in a key of {keys}")
    target = spark.table(name)
    merged = merged_buckets(target, arrived, keys, update_cols, now, partition_col)
    # As many tasks as buckets, so each bucket of a partition is one file.
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        merged.select(*target.columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    spark.catalog.refreshTable(name)
