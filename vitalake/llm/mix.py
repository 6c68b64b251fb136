"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are put in a hash order and served in that order, again from the start after the last one.
A document's virtual finish time is the number of its source's words up to its end over the source's target, so
all sources come near their targets at virtual time 1. The mix is the global order of finish times: documents are
taken whole until the total budget is used, and only the one that reaches it is taken in part. What a source lacks
of its target, or has beyond it, is less than the words of one of its documents, but for the part-taken one and
the documents that fill up what others leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitalake.session import stored

#: Words are runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["_null", "_src"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: int) -> DataFrame:
    """Size and target per source. Sources by code point (null last) take the weights in turn; a target stops at
    ``max_epochs`` times the source's size and its excess goes to the others by weight, until none is above.

    In order of capacity over weight, a source is full exactly if it is full at the level that the words not yet
    given would reach over it and all later ones; the level at the first one that is not full holds for the rest.
    One row per source: the windows over all of them see as many rows as there are sources.
    """
    n = len(weights)
    ranked = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(W.orderBy(*SOURCE)) - 1) % n + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * max_epochs)
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), *SOURCE)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = ranked.withColumns({
        "_budget": F.sum("source_size").over(everything) * F.lit(float(budget_share)),
        "_given": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("_w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)),
    }).withColumn("_level", (F.col("_budget") - F.col("_given")) / F.col("_left"))
    full = F.col("_cap") <= F.col("_level") * F.col("_w")
    common = F.first(F.when(~full, F.col("_level")), ignorenulls=True).over(everything)
    return levels.withColumns({"_full": full, "_common": common}).select(
        *SOURCE, "source_size", "_budget",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_common") * F.col("_w")).alias("target"),
    )


def running_sum(df: DataFrame, keys: list[str], slice_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one, per key. A key is cut into slices that follow the order, so
    that no task holds a whole key; only one row per slice is summed over the key."""
    before = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("_slice_sum")).withColumn(
        "_base", F.coalesce(F.sum("_slice_sum").over(W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_slice_sum")
    inner = W.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(before, [*keys, slice_col]).withColumn(out, (F.col("_inner") + F.col("_base")).cast("long")).drop("_inner", "_base")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_epochs: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slices: int = 4096,
) -> DataFrame:
    """The mix in draws: ``(id, source, size, source_size, target, epoch, finish, taken, offset)``.

    ``taken`` are the words of the document in this epoch, ``offset`` its place (in words) in the mix; rows that
    take nothing (offset null: empty, or after the cut) are kept, so each document has ``max_epochs`` rows. Nulls: a null text has size 0, null sources
    are one source, the last. Repeated rows count each. The order of a source is that of md5(id), so reruns agree;
    rows with one id follow by size. An empty table gives no rows. Only ids, sources and sizes are shuffled; they
    are written once to the shared folder, so that the texts are read and their words counted once.
    """
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"),
    ).withColumns({
        "_null": F.col("_source").isNull(), "_src": F.coalesce(F.col("_source"), F.lit("")),
        "_order": F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")),
    }).withColumn("_slice", (F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * slices / 16**6).cast("int"))
    sized = stored(sized, "mix")
    shuffled = running_sum(sized, SOURCE, "_slice", ["_order", "_id", "size"], "size", "_before")
    known = shuffled.join(source_targets(sized, weights, budget_share, max_epochs), SOURCE)
    draws = known.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn(
        "_start", F.col("_before") + F.col("epoch") * F.col("source_size")
    ).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("_start") + F.col("size")) / F.col("target")).otherwise(0.0)
    ).withColumns({
        # finish times have no upper bound: 1 - 1 / (1 + finish) rises with them and stays below 1. Empty documents
        # shift no one, so any slice will do and they are spread
        "_time": F.when(F.col("size") > 0, F.floor((1 - 1 / (1 + F.col("finish"))) * (2 * slices)).cast("int")).otherwise(F.col("_slice")),
        "_all": F.lit(0),
    })
    ordered = running_sum(draws, ["_all"], "_time", ["finish", *SOURCE, "epoch", "_order", "_id", "size"], "size", "offset")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("_budget")) - F.col("offset"))).cast("long")
    return ordered.withColumn("taken", taken).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "epoch", "finish", "taken",
        F.when(F.col("taken") > 0, F.col("offset")).alias("offset"),
    )


def per_document(draws: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: its words taken over all epochs. Rows with equal id, source and size are told apart
    by their place in the order, which differs unless they are empty."""
    place = F.row_number().over(W.partitionBy(id_col, source_col, "size", "epoch").orderBy("finish"))
    return draws.withColumn("_place", place).groupBy(id_col, source_col, "size", "_place").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    ).select(id_col, "size", "source_size", "target", "taken")


def sql(docs: str, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_epochs: int = 2) -> str:
    """DuckDB text of ``per_document(mix(...))`` over the relation ``docs``."""
    return f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS o,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM {docs}),
ranked AS (
  SELECT n, s, sum(size)::BIGINT AS source_size, [{', '.join(f'{float(w)}::DOUBLE' for w in weights)}][((row_number() OVER (ORDER BY n, s) - 1) % {len(weights)} + 1)::INT] AS w
  FROM sized GROUP BY n, s),
levels AS (
  SELECT *, source_size * {max_epochs} AS cap, sum(source_size) OVER ()::DOUBLE * {float(budget_share)}::DOUBLE AS budget,
    coalesce(sum(source_size * {max_epochs}) OVER (ORDER BY source_size * {max_epochs} / w, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS given,
    sum(w) OVER (ORDER BY source_size * {max_epochs} / w, n, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ranked),
marked AS (SELECT *, (budget - given) / rest AS level, cap <= (budget - given) / rest * w AS fullup FROM levels),
targets AS (
  SELECT n, s, source_size, budget, CASE WHEN fullup THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, cap / w) FROM marked WHERE NOT fullup) * w END AS target FROM marked),
placed AS (
  SELECT z.*, t.source_size, t.target, t.budget,
    coalesce(sum(size) OVER (PARTITION BY z.n, z.s ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized z JOIN targets t ON z.n = t.n AND z.s = t.s),
timed AS (
  SELECT p.*, e.epoch,
    CASE WHEN target > 0 THEN (before + e.epoch * source_size + size) / target ELSE 0 END AS finish
  FROM placed p, range({max_epochs}) e(epoch)),
cut AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, n, s, epoch, o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_words FROM timed)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, floor(budget) - offset_words)))::BIGINT AS taken
FROM cut GROUP BY doc_id, n, s, o, size, source_size, target, before"""
