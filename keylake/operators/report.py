"""Reports over records and requests: storage, metrics, capped cardinality, percentiles, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRIC_ROWS = 256
OVERFLOW = "{overflow}"


def storage(records: DataFrame, size: Column, total: bool = False) -> DataFrame:
    """Live records and bytes of each schema, and of all (schema null) if asked."""
    grouped = records.withColumn("_bytes", size)
    grouped = grouped.rollup("schema") if total else grouped.groupBy("schema")
    return grouped.agg(F.count("*").alias("records"), F.sum("_bytes").cast("long").alias("bytes"))


def storage_order() -> list[Column]:
    return [F.desc("bytes"), F.asc("schema")]


def request_metrics(requests: DataFrame, keys: list[str], refusals: list[str]) -> DataFrame:
    """Per keys: requests, total and longest time, items, and refusals by code (a column each).

    requests: keys, nanos, items, code (null: served).
    """
    by_code = [F.count_if(F.col("code") == c).alias(f"refused_{c}") for c in refusals]
    return requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("nanos").alias("total_nanos"), F.max("nanos").alias("max_nanos"), F.sum("items").alias("items"), *by_code)


def capped(events: DataFrame, key: str, order: str, rows: int = METRIC_ROWS) -> DataFrame:
    """Counts of the first keys seen, in order of their first event, and of all others together as overflow.

    The keys kept are a bounded set found by aggregation and a top-k, so broadcasting them is safe at any size.
    """
    first = events.groupBy(key).agg(F.min(order).alias("_first"))
    kept = first.orderBy("_first", key).limit(rows).select(F.col(key).alias("_kept"))
    named = events.join(F.broadcast(kept), F.col(key).eqNullSafe(F.col("_kept")), "left")
    label = F.when(F.col("_kept").isNull(), OVERFLOW).otherwise(F.col(key).cast("string"))
    return named.groupBy(label.alias(key)).agg(F.count("*").alias("n"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(n * share), by keys.

    Distinct values are counted first, so the window sees one row a value, not one a row.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = counted.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    picks = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(share)), F.col(value))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(*keys).agg(F.max("_all").alias("samples"), *picks)


def slope(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y over x, by keys."""
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"))
