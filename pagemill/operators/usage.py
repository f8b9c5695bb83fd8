"""Model catalogue and the cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_name(c: Column) -> Column:
    """Names that differ in blanks at the edges, case and underscores are one."""
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def total(usage: DataFrame) -> DataFrame:
    """The same over all calls: one row, of zeros where there is none."""
    return cost(usage, []).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "input_tokens", "output_tokens", "total_tokens")], F.coalesce("cost", F.lit(0.0)).alias("cost"))


def cost(usage: DataFrame, by: list[str]) -> DataFrame:
    """(by, requests, input_tokens, output_tokens, total_tokens, cost): answered calls only count as requests; null tokens are none.

    Each call is priced by itself, so mixed prices are right. The sum is a decimal, so it doesn't depend on its order.
    """
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    price = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,6)")
    each = (i.cast("decimal(18,0)") * price("input_price") + o.cast("decimal(18,0)") * price("output_price")).cast("decimal(28,6)")
    return usage.groupBy(*by).agg(
        F.count_if(o > 0).alias("requests"), F.sum(i).alias("input_tokens"), F.sum(o).alias("output_tokens"), F.sum(i + o).alias("total_tokens"),
        F.round(F.sum(each).cast("double") / 1e6, 9).alias("cost"),
    )


def resolved(tasks: DataFrame, routes: DataFrame, models: DataFrame, providers: DataFrame, primary: str, fallback: str, override: str = "") -> DataFrame:
    """(task, model, provider, base_url, configured): a task's model, else the primary; a provider without key gives way to the fallback.

    All tables are catalogues. A model that isn't in the catalogue has null provider and isn't configured. With ``override`` every task has that
    model alone, and its being missing or not configured is an error when the rows are read.
    """
    if override:
        tasks, routes, primary, fallback = tasks, routes.limit(0), override, ""
    known = models.select(F.col("name").alias("m"), F.col("provider").alias("p")).join(providers.select(F.col("name").alias("p"), "base_url", "configured"), "p", "left")
    chosen = tasks.join(routes, "task", "left").select("task", F.coalesce("model", F.lit(primary)).alias("want"))
    first = chosen.join(known, chosen.want == known.m, "left")
    spare = known.filter((F.col("m") == fallback) & F.col("configured")).select(F.col("m").alias("fm"), F.col("p").alias("fp"), F.col("base_url").alias("fb"))
    out = first.join(spare, ~F.coalesce(first.configured, F.lit(False)), "left")
    swap = F.col("fm").isNotNull()
    if override:
        out = out.withColumn("configured", F.when(F.coalesce("configured", F.lit(False)), True).otherwise(F.raise_error(F.lit(f"Model '{override}' not found or not configured")).cast("boolean")))
    return out.select("task", F.when(swap, F.col("fm")).otherwise(F.col("want")).alias("model"), F.when(swap, F.col("fp")).otherwise(F.col("p")).alias("provider"), F.when(swap, F.col("fb")).otherwise(F.col("base_url")).alias("base_url"), (swap | F.coalesce("configured", F.lit(False))).alias("configured"))
