"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text's distinct paragraphs are hashed to 64-bit digests, and each digest is added to one cell of each of three
subtables; a cell keeps the count, the xor of its digests and the xor of their check hashes. Subtracting two
sketches leaves the digests in which the texts differ; cells with one digest give it up (peeling) until the
sketch is empty. A difference too large to peel is tried again in a larger sketch: the digests are dealt out to
as many shards as their number asks for, and a shard that still fails is dealt out once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitalake.functions import arrays as A

#: Hash functions (one subtable each), cells per subtable, and rounds of peeling.
TABLES, CELLS, ROUNDS = 3, 12, 12
CELL = "struct<n:int,k:bigint,c:bigint>"
#: Digests of a difference that a shard should have to peel.
PER_SHARD = 8


def paragraphs(text: Column) -> Column:
    """Distinct digests of the non-blank lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n+"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(-1)), 32)


def _entry(key: Column, seed: int) -> Column:
    """A digest with its check hash and its cell in each subtable."""
    places = [F.pmod(F.xxhash64(key, F.lit(seed * TABLES + j)), F.lit(CELLS)).cast("int").alias(f"p{j}") for j in range(TABLES)]
    return F.struct(F.lit(1).alias("n"), key.alias("k"), _check(key).alias("c"), *places)


def _zero() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))


def _add(cell: Column, entry: Column, sign: int) -> Column:
    n = (cell["n"] + entry["n"]) if sign > 0 else (cell["n"] - entry["n"])
    return F.struct(n.alias("n"), cell["k"].bitwiseXOR(entry["k"]).alias("k"), cell["c"].bitwiseXOR(entry["c"]).alias("c"))


def _apply(cells: Column, entries: Column, sign: int) -> Column:
    """Cells with all entries added (or taken away): subtable ``j`` starts at ``j * CELLS``."""
    def table(j: int) -> Column:
        return F.transform(F.slice(cells, j * CELLS + 1, CELLS), lambda cell, i: F.aggregate(
            F.filter(entries, lambda e: e[f"p{j}"] == i), cell, lambda acc, e: _add(acc, e, sign)))

    return F.concat(*[table(j) for j in range(TABLES)])


def build(keys: Column, seed: int = 0) -> Column:
    """The sketch of an array of distinct digests; the work is linear in their number."""
    empty = F.array_repeat(_zero(), TABLES * CELLS)
    return A.let(F.transform(keys, lambda k: _entry(k, seed)), lambda entries: _apply(empty, entries, 1))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _add(x, y, -1))


def peel(cells: Column, seed: int = 0) -> Column:
    """``struct(ok, plus, minus)``: whether the sketch came empty, and the digests of either sign found."""
    keys = "array<struct<n:int,k:bigint,c:bigint,p0:int,p1:int,p2:int>>"
    start = F.struct(cells.alias("cells"), F.array().cast(keys).alias("found"))

    def step(state: Column, _round: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        entries = F.array_distinct(F.transform(pure, lambda c: F.struct(
            c["n"].alias("n"), *[_entry(c["k"], seed)[name].alias(name) for name in ("k", "c", "p0", "p1", "p2")])))
        return A.let(entries, lambda es: F.struct(
            _apply(state["cells"], es, -1).alias("cells"), F.concat(state["found"], es).alias("found")))

    def end(state: Column) -> Column:
        return F.struct(
            F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)).alias("ok"),
            F.transform(F.filter(state["found"], lambda e: e["n"] == 1), lambda e: e["k"]).alias("plus"),
            F.transform(F.filter(state["found"], lambda e: e["n"] == -1), lambda e: e["k"]).alias("minus"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, end)


def _counts(found: Column) -> Column:
    return F.struct(F.size(found["plus"]).alias("plus"), F.size(found["minus"]).alias("minus"))


def _exact(a: Column, b: Column) -> Column:
    return F.struct(F.size(F.array_except(a, b)).alias("plus"), F.size(F.array_except(b, a)).alias("minus"))


def _total(parts: Column) -> Column:
    zero = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"))
    return F.aggregate(parts, zero, lambda acc, p: F.struct((acc["plus"] + p["plus"]).alias("plus"), (acc["minus"] + p["minus"]).alias("minus")))


def _dealt(a: Column, b: Column, shards: Column, salt: int, work: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``work`` over the shards of both digest arrays. The shards are reached in two steps, so that dealing
    out costs the root of their number per digest."""
    steps = F.ceil(F.sqrt(shards)).cast("int")

    def pick(keys: Column, i: Column, k: int, n: Column) -> Column:
        return F.filter(keys, lambda x: F.pmod(F.xxhash64(x, F.lit(salt + k)), n) == i)

    def coarse(n: Column) -> Column:
        def fine(x: Column, y: Column) -> Column:
            return _total(F.transform(F.sequence(F.lit(0), n - 1), lambda j: A.let(
                F.struct(pick(x, j, 1, n).alias("x"), pick(y, j, 1, n).alias("y")), lambda s: work(s["x"], s["y"]))))

        return _total(F.transform(F.sequence(F.lit(0), n - 1), lambda i: A.let(
            F.struct(pick(a, i, 0, n).alias("x"), pick(b, i, 0, n).alias("y")), lambda s: fine(s["x"], s["y"]))))

    return A.let(steps, coarse)


def _tried(a: Column, b: Column, seed: int, otherwise: Callable[[], Column]) -> Column:
    return A.let(peel(subtract(build(a, seed), build(b, seed)), seed), lambda r: F.when(r["ok"], _counts(r)).otherwise(otherwise()))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """``struct(plus, minus)``: numbers of digests that only the first or only the second text has.

    First the two given sketches; then shards for all digests; then the failed shards in nine parts with other
    hashes. What defeats even these (less than one text in 10**9) is compared directly.
    """
    def again(x: Column, y: Column) -> Column:
        return _tried(x, y, 1, lambda: _dealt(x, y, F.lit(9), 200, lambda u, v: _tried(u, v, 2, lambda: _exact(u, v))))

    def larger(pair: Column) -> Column:
        return _dealt(pair["a"], pair["b"], (F.size(pair["a"]) + F.size(pair["b"])) / PER_SHARD, 100, again)

    first = peel(subtract(cells_a, cells_b))
    bound = F.struct(first.alias("first"), a.alias("a"), b.alias("b"))
    return A.let(bound, lambda s: F.when(s["first"]["ok"], _counts(s["first"])).otherwise(larger(s)))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared over all distinct paragraphs; 1 for two texts without any."""
    return A.let(F.struct(difference(a, b, cells_a, cells_b).alias("d"), F.size(a).alias("n")), lambda s: F.when(
        s["n"] + s["d"]["minus"] == 0, 1.0).otherwise((s["n"] - s["d"]["plus"]) / (s["n"] + s["d"]["minus"])))


def as_text(cells: Column) -> Column:
    """A sketch as text: per cell the count, the digest xor and the check xor in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws("-", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"]))), ".")


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int = 256, rows_per_bucket: int = 20_000) -> DataFrame:
    """``(id, text, next_text)``: the text of the next row by descending id (then text); the last is followed by the first.

    Ids (numbers) are cut into ``ranges`` quantile ranges, and each of those evenly into as many buckets as
    ``rows_per_bucket`` asks for. A window runs inside each bucket; over the whole table only bucket numbers are ordered.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    shares = [i / ranges for i in range(ranges + 1)]
    seen = rows.agg(F.percentile_approx("_id", shares, 4 * ranges).alias("b"), F.count("_id").alias("n")).first()
    bounds = sorted(set(seen["b"] or []))
    parts = max(1, -(-seen["n"] // (ranges * rows_per_bucket)))
    edges = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<bigint>")
    at = F.size(F.filter(edges, lambda e: e <= F.col("_id")))
    bucket = at.cast("long") * parts
    if parts > 1:
        low, high = (F.get(edges, F.greatest(F.lit(0), F.least(F.lit(len(bounds) - 1), at - k))) for k in (1, 0))
        share = (F.col("_id").cast("double") - low) / F.greatest(F.lit(1.0), high.cast("double") - low)
        bucket += F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts)))
    cut = rows.withColumn("_bucket", F.when(F.col("_id").isNull(), -1).otherwise(bucket))
    inside = W.partitionBy("_bucket").orderBy(F.col("_id").desc(), F.col("_text").desc())
    ranked = cut.withColumns({"_rank": F.row_number().over(inside), "_lead": F.lead("_text").over(inside)})
    heads = ranked.where(F.col("_rank") == 1).select(F.col("_bucket").alias("_next"), F.col("_text").alias("_head"))
    every = W.orderBy(F.col("_of").desc())
    following = cut.select(F.col("_bucket").alias("_of")).distinct().select(
        "_of", F.coalesce(F.lead("_of").over(every), F.max("_of").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_next"))
    carried = following.join(heads, "_next").select("_of", "_head")
    joined = ranked.join(carried, (F.col("_bucket") == F.col("_of")) & F.col("_lead").isNull(), "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.coalesce("_lead", "_head").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the other text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one per input row.

    A null text is empty; an empty text has no paragraphs and the sketch of zeros. Paragraphs are non-blank lines,
    repeated ones count once, so texts that differ only in that have equal fingerprints. Rows with equal ids
    follow by text, null ids come last. Texts are read whole; they cross one shuffle.
    """
    pairs = with_next(docs, id_col, text_col).withColumn("_edited", edited(F.col(text_col), F.col("next_text")))
    keyed = pairs.select(
        id_col, F.length(text_col).cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        paragraphs(F.col(text_col)).alias("_a"), paragraphs(F.col("_edited")).alias("_b"), paragraphs(F.col("next_text")).alias("_c"),
    )
    cells = keyed.withColumns({f"_cells{x}": build(F.col(f"_{x}")) for x in "abc"})
    like = lambda x: likeness(F.col("_a"), F.col(f"_{x}"), F.col("_cellsa"), F.col(f"_cells{x}"))
    return cells.select(
        id_col, "n_chars", "edited_sha256", as_text(F.col("_cellsa")).alias("fingerprint"), as_text(F.col("_cellsb")).alias("edited_fingerprint"),
        like("b").alias("near_edited"), like("c").alias("near_next"),
    )
