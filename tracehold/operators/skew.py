"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that a task may get; a key with more is spread over as many tasks as it takes.
TASK_ROWS = 1_000_000
#: Spread keys at most; a task may get more rows once there are so many.
MAX_HOT_KEYS = 1 << 16


def hot_keys(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> dict:
    """Tasks to spread each key over, for keys with more rows than one task should get.

    The size is absolute, so a key is spread the further the more rows it has. Counting
    combines map-side and moves keys only. Runs one job; at most ``MAX_HOT_KEYS`` come back,
    since so many keys above a larger size cannot exist.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    counts = counts.filter(F.col("_n") > task_rows)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    size = max(task_rows, total // MAX_HOT_KEYS)
    return {row[0]: -(-row["_n"] // size) for row in counts.filter(F.col("_n") > size).collect()} if total else {}


def join_ends(
    edges: DataFrame, source: DataFrame, source_key: str, target: DataFrame, target_key: str
) -> DataFrame:
    """Inner join of (src, dst) rows to one table per end, each unique by its key.

    Hub nodes of either end are counted on the edges themselves and spread.
    """
    hot_targets = hot_keys(edges, "dst")
    one = lookup(edges, "src", source, source_key, "inner")
    return lookup(one, "dst", target, target_key, "inner", hot_targets)


def lookup(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    how: str = "left",
    hot: dict | None = None,
) -> DataFrame:
    """Join rows to a table that is unique by its key, with hot keys spread out.

    Rows of a hot key are spread by a hash of the whole row over as many tasks as
    ``hot`` says, and the table's row of that key is repeated for each; rows without
    a key match nothing and are spread freely. All other rows join as usual. Nothing
    is dropped. ``hot`` comes from ``hot_keys``, counted here if not given.

    The salt depends on the row alone, so a task that runs again sends its rows to
    the same places.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if how == "inner" and not hot:
        return rows.join(table, F.col(key) == F.col(table_key))
    hashable = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.xxhash64(*hashable)
    left, right = rows.withColumn("_tasks", F.lit(1)), table.withColumn("_tasks", F.lit(1))
    if hot:
        kind = rows.schema[key].dataType.simpleString()
        known = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), f"_hot {kind}, _tasks int"))
        left = rows.join(known, F.col(key) == F.col("_hot"), "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1))).drop("_hot")
        right = table.join(known, F.col(table_key) == F.col("_hot"), "left").withColumn(
            "_tasks", F.coalesce("_tasks", F.lit(1))).drop("_hot")
    salt = F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, F.col("_tasks").cast("long")))
    left = left.withColumn("_salt", salt).drop("_tasks")
    copies = F.sequence(F.lit(0).cast("long"), F.col("_tasks").cast("long") - 1)
    right = right.withColumn("_copy", F.explode(copies)).drop("_tasks")
    match = (F.col(key) == F.col(table_key)) & (F.col("_salt") == F.col("_copy"))
    return left.join(right, match, how).drop("_salt", "_copy")
