"""Span and trace metrics and token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.sources.dims import MODEL_PRICES
from vitalake.session import cut_lineage


def span_metrics(spans: DataFrame) -> DataFrame:
    """Totals over all spans; a zero or missing duration is unknown."""
    known = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    errors = F.count(F.when(F.col("status") == "error", 1))
    return spans.agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count("duration_ms").alias("completed_spans"),
        errors.alias("error_spans"),
        F.round(errors / F.count(F.lit(1)), 6).alias("error_rate"),
        F.round(F.avg(known), 6).alias("avg_duration"),
        F.min(known).alias("min_duration"),
        F.max(known).alias("max_duration"),
        F.sum(known).alias("total_duration"),
    )


def span_metrics_by_operation(spans: DataFrame) -> DataFrame:
    """Count, errors and mean known duration per span name."""
    known = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return spans.groupBy("name").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        F.round(F.avg(known), 6).alias("avg_duration"),
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """Duration, spans, tokens, cost and errors per trace."""
    return spans.groupBy("trace_id").agg(
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"),
        F.count(F.lit(1)).alias("span_count"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_count"),
    )


def trace_session_summary(spans: DataFrame) -> DataFrame:
    """As A20 with model calls; the mean divides known durations by all spans."""
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count(F.when(F.col("span_type") == "llm", 1)).alias("model_calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_count"),
        F.round(F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("average_duration_ms"),
    )


def span_tree(spans: DataFrame) -> DataFrame:
    """Root and depth of every span, to any depth.

    Each round replaces a span's pointer by its ancestor's pointer, so the
    number of joins is the logarithm of the depth. A parent that is not in the
    table makes its child a root. Spans in a cycle, or below one, have no root:
    after as many rounds as the number of spans allows they get nulls.
    """
    ids = spans.select(F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_known"))
    links = spans.select("span_id", "parent_span_id").join(ids, "parent_span_id", "left")
    up = F.when(F.col("_known"), F.col("parent_span_id"))
    state = links.select(
        "span_id", F.coalesce(up, F.col("span_id")).alias("root_span_id"),
        F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
    )
    state = cut_lineage(state)
    rounds = state.count().bit_length() + 1
    while True:
        above = state.select(
            F.col("span_id").alias("root_span_id"), F.col("root_span_id").alias("_top"), F.col("depth").alias("_more")
        ).where(F.col("_more") > 0)
        joined = state.join(above, "root_span_id", "left")
        step = cut_lineage(joined.select(
            "span_id", F.coalesce("_top", "root_span_id").alias("root_span_id"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
            F.col("_top").isNotNull().alias("_moved"),
        ))
        state = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return state
        rounds -= 1
        if rounds == 0:
            return step.select("span_id", *[F.when(~F.col("_moved"), F.col(c)).alias(c) for c in ("root_span_id", "depth")])


def model_price(model: Column, index: int) -> Column:
    """Price of a model name by exact, then prefix, then contained name, in price-list order."""
    lowered = F.lower(model)
    exact = prefix = inside = None
    for name, *prices in MODEL_PRICES:
        value = F.lit(prices[index])
        exact = F.when(model == name, value) if exact is None else exact.when(model == name, value)
        starts, holds = lowered.startswith(name.lower()), lowered.contains(name)
        prefix = F.when(starts, value) if prefix is None else prefix.when(starts, value)
        inside = F.when(holds, value) if inside is None else inside.when(holds, value)
    default = dict((n, p) for n, *p in MODEL_PRICES)["default"][index]
    return F.coalesce(exact, prefix, inside, F.lit(default))


def token_cost(model: Column, prompt: Column, completion: Column, total: Column) -> Column:
    """Cost in dollars; when only a total is known 90 % of it counts as input."""
    split = (prompt == 0) & (completion == 0) & (total > 0)
    inputs = F.when(split, F.floor(total * 0.9)).otherwise(prompt)
    outputs = F.when(split, total - F.floor(total * 0.9)).otherwise(completion)
    return F.round(
        inputs / 1000.0 * model_price(model, 0) + outputs / 1000.0 * model_price(model, 1), 6
    )


def state_changes(before: Column, after: Column) -> Column:
    """``added_k`` and ``modified_k`` for two string maps, in key order."""
    keys = F.array_sort(F.map_keys(after))
    marks = F.transform(
        keys,
        lambda k: F.when(~F.map_contains_key(before, k), F.concat(F.lit("added_"), k)).when(
            ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)), F.concat(F.lit("modified_"), k)
        ),
    )
    return F.array_compact(marks)


def export_spans(spans: DataFrame, path: str) -> None:
    """One flat record per span."""
    spans.select(
        "trace_id", "span_id", "parent_span_id", "name", "span_type", "status", "duration_ms", "total_tokens", "model"
    ).write.mode("error").json(path)
