"""Usage and cost: ``usage_events(session, ts, model, input_tokens, output_tokens, duration_s)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: USD per million tokens (key, input, output).
PRICING = [
    ("deepseek-v4-flash", 0.14, 0.55), ("deepseek-v4-pro", 0.27, 1.10), ("deepseek-chat", 0.27, 1.10), ("deepseek-reasoner", 0.55, 2.19), ("deepseek", 0.27, 1.10),
    ("claude-opus-4-7", 15.0, 75.0), ("claude-opus", 15.0, 75.0), ("claude-sonnet-4-6", 3.0, 15.0), ("claude-sonnet", 3.0, 15.0), ("claude-haiku-4-5", 1.0, 5.0), ("claude-haiku", 1.0, 5.0),
    ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1", 2.5, 10.0), ("o1", 15.0, 60.0),
    ("mistral-large", 2.0, 6.0), ("mistral-small", 0.2, 0.6), ("mistral-medium", 0.4, 2.0), ("codestral", 0.2, 0.6), ("ministral", 0.04, 0.04), ("mixtral", 0.7, 0.7), ("mistral", 0.2, 0.6),
    ("llama", 0.0, 0.0), ("qwen", 0.0, 0.0), ("ollama", 0.0, 0.0),
]


def pricing_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICING, "key string, input_usd_per_m double, output_usd_per_m double")


def with_price(usage: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """Adds both rates by the longest key that the model's name holds; unknown models get 0.

    Only distinct models meet the price table, in a nested-loop join of two small sides.
    """
    if pricing is None:
        rates = F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(k).alias("key"), F.lit(i).alias("i"), F.lit(o).alias("o")) for k, i, o in PRICING])
        best = F.array_max(F.filter(rates, lambda r: F.contains(F.lower("model"), r["key"])))
        return usage.withColumn("_p", best).withColumns({"input_usd_per_m": F.coalesce("_p.i", F.lit(0.0)), "output_usd_per_m": F.coalesce("_p.o", F.lit(0.0))}).drop("_p")
    models = usage.select("model").distinct()
    hits = models.join(F.broadcast(pricing), F.contains(F.lower("model"), F.col("key")))
    best = hits.groupBy("model").agg(F.max(F.struct(F.length("key").alias("n"), "key", "input_usd_per_m", "output_usd_per_m")).alias("p"))
    priced = usage.join(best, "model", "left")
    return priced.withColumns({c: F.coalesce(f"p.{c}", F.lit(0.0)) for c in ("input_usd_per_m", "output_usd_per_m")}).drop("p")


def with_cost(usage: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """Adds ``cost_usd`` (0 if unpriced) and ``is_priced``."""
    cost = (F.col("input_tokens") * F.col("input_usd_per_m") + F.col("output_tokens") * F.col("output_usd_per_m")) / 1_000_000
    return with_price(usage, pricing).withColumn("cost_usd", cost).withColumn("is_priced", (F.col("input_usd_per_m") != 0) | (F.col("output_usd_per_m") != 0))


def usage_by_session(costed: DataFrame) -> DataFrame:
    out = costed.groupBy("session").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("duration_s").alias("duration_s"), F.sum("cost_usd").alias("cost_usd"))
    return out.withColumn("tokens_per_s", F.when(F.col("duration_s") > 0.01, F.col("output_tokens") / F.col("duration_s")))


def running_usage(costed: DataFrame, tie: str | None = None) -> DataFrame:
    """Totals within a session after each call; calls of one time count together unless the column ``tie`` orders them."""
    w = Window.partitionBy("session")
    w = w.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0) if tie is None else w.orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, 0)
    return costed.withColumns({"total_input": F.sum("input_tokens").over(w), "total_output": F.sum("output_tokens").over(w), "total_cost": F.sum("cost_usd").over(w)})


def call_durations(events: DataFrame) -> DataFrame:
    """``session, ts, duration_s, tokens_per_s`` of each end event, from the start just before it.

    events(session, ts, kind 'start' or 'end', output_tokens); throughput needs over 0.01 s and some output.
    """
    w = Window.partitionBy("session").orderBy("ts", F.when(F.col("kind") == "start", 0).otherwise(1))
    paired = events.withColumns({"p": F.lag("ts").over(w), "k": F.lag("kind").over(w)}).filter("kind = 'end' and k = 'start'")
    seconds = F.col("ts").cast("timestamp").cast("double") - F.col("p").cast("timestamp").cast("double")
    return paired.select("session", "ts", seconds.alias("duration_s"), F.when((seconds > 0.01) & (F.col("output_tokens") > 0), F.col("output_tokens") / seconds).alias("tokens_per_s"))
