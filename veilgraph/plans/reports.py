"""Reports over long tables of samples (seed, method, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(samples: DataFrame) -> DataFrame:
    """(method, metric, n, mean, rel_std): rel_std is the population deviation over the mean, null where the mean is 0."""
    return samples.groupBy("method", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("rel_std"))


def wide(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """(method, one column per metric): means. The metrics are given, so nothing is collected to find them."""
    return samples.groupBy("method").pivot("metric", metrics).agg(F.avg("value"))


def long(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The reverse of ``wide``: (keys, metric, value)."""
    return table.unpivot(keys, values, "metric", "value")


def average_rank(by: list[str], value: Column | str) -> Column:
    """Rank from 1 in a group, ties sharing the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def best(samples: DataFrame, n: int = 3) -> DataFrame:
    """The n methods with the smallest mean of each metric."""
    means = samples.groupBy("method", "metric").agg(F.avg("value").alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy("mean", "method"))).where(F.col("place") <= n)


def relative(samples: DataFrame, baseline: str) -> DataFrame:
    """Values over the mean of the baseline method on the same metric."""
    base = samples.where(F.col("method") == baseline).groupBy("metric").agg(F.avg("value").alias("base"))
    return samples.join(base, "metric").withColumn("ratio", F.col("value") / F.nullif("base", F.lit(0.0)))


def without_outliers(samples: DataFrame, most: float) -> DataFrame:
    """Values over ``most`` as null."""
    return samples.withColumn("value", F.when(F.col("value") <= most, F.col("value")))


def weighted_mean(table: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, mean): sums of value times weight over sums of weight."""
    return table.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean"))


def with_group_mean(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Every row with its group's mean."""
    return samples.withColumn("group_mean", F.avg(value).over(Window.partitionBy(*by)))


def describe(samples: DataFrame, value: str = "value") -> DataFrame:
    """(metric, n, mean, std, low, q25, q50, q75, high)."""
    quarters = [F.percentile(value, F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return samples.groupBy("metric").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), *quarters, F.max(value).alias("high"))


def renamed(samples: DataFrame, names: dict[str, str], column: str = "method") -> DataFrame:
    """Values of a column replaced by others; those without another stay."""
    return samples.replace(names, subset=[column])


def arranged(table: DataFrame, key: str, order: list) -> DataFrame:
    """Rows in the order of the keys given, one at least for each (of nulls where the table has none); rows with other keys go."""
    places = table.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} {table.schema[key].dataType.simpleString()}, _place int")
    return places.join(table, key, "left").orderBy("_place").select(table.columns)


def transposed(table: DataFrame, key: str, columns: list) -> DataFrame:
    """Columns as rows (name, one column per key in ``columns``), for a report's few numeric columns."""
    values = [c for c in table.columns if c != key]
    return table.unpivot([key], values, "name", "_value").groupBy("name").pivot(key, columns).agg(F.first("_value"))


def latex(table: DataFrame, digits: int = 3, most_rows: int = 1000) -> str:
    """A LaTeX tabular of a report's rows; refuses tables that aren't reports."""
    rows = table.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    cell = lambda x: "--" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("_", r"\_")
    lines = [" & ".join(map(cell, r)) + r" \\" for r in [tuple(table.columns), *map(tuple, rows)]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
