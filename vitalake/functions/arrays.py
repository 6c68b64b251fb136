"""Array expressions on one record's own lists (all JVM-side, order-preserving)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def explode_items(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per item. A plain explode makes the optimizer test the whole list expression for
    emptiness below the generator, which computes it again; the outer form with a filter above does not."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once: a lambda argument is a value, an outer expression is run per item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key is not blank and has not been seen before in the list."""
    def pick(it: Column, keys: Column) -> Column:
        distinct = F.filter(F.array_distinct(keys), lambda k: k != "")
        return F.transform(distinct, lambda k: F.get(it, F.array_position(keys, k).cast("int") - 1))

    return let(items, lambda it: let(F.transform(it, key), lambda keys: pick(it, keys)))


def union_ignore_case(*lists: Column) -> Column:
    """Ordered union, trimmed, case-insensitive, first spelling wins."""
    joined = F.transform(F.concat(*[F.coalesce(x, empty("string")) for x in lists]), lambda x: F.trim(x))
    return keep_first(F.filter(joined, lambda x: x.isNotNull()), lambda x: F.lower(x))


def append_absent(existing: Column, new: Column) -> Column:
    """Existing items as they are, then new items that are not among them."""
    return F.concat(existing, F.filter(new, lambda x: ~F.array_contains(existing, x)))


def words(text: Column) -> Column:
    """Distinct lower-case whitespace words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 when either side has none."""
    return jaccard(words(a), words(b))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / total)


def union_unlike(existing: Column, new: Column, threshold: float = 0.7) -> Column:
    """Existing items, then new ones that resemble no *existing* item."""
    return F.concat(
        existing,
        let(
            F.transform(existing, words),
            lambda sets: F.filter(
                new, lambda x: let(words(x), lambda w: ~F.exists(sets, lambda s: jaccard(w, s) > threshold))
            ),
        ),
    )


def repeated(items: Column) -> Column:
    """Lower-case items that occur more than once, in first-seen order."""
    return let(
        F.transform(items, lambda x: F.lower(F.trim(x))),
        lambda low: F.array_distinct(F.filter(low, lambda x, i: F.array_position(low, x) < i + 1)),
    )


def match_greedy(
    existing: Column, new: Column, prepare: Callable[[Column], Column], test: Callable[[Column, Column], Column]
) -> Column:
    """For each existing item the index of the first unused new item that passes ``test``, else -1.

    ``prepare`` turns an item into what ``test`` compares; it runs once per item.
    """
    start = F.array().cast("array<int>")
    numbered = F.transform(new, lambda x, i: F.struct(i.alias("i"), prepare(x).alias("k")))
    bound = F.struct(F.transform(existing, prepare).alias("old"), numbered.alias("new"))

    def pick(used: Column, key: Column, candidates: Column) -> Column:
        open_ones = F.filter(candidates, lambda c: ~F.array_contains(used, c["i"]) & test(key, c["k"]))
        return F.concat(used, F.array(F.coalesce(F.get(open_ones, F.lit(0))["i"], F.lit(-1))))

    return let(bound, lambda s: F.aggregate(s["old"], start, lambda used, key: pick(used, key, s["new"])))


def outer_merge(existing: Column, new: Column, matches: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Merged or kept existing items in order, then the new items no one matched."""
    kept = F.transform(
        existing,
        lambda item, i: F.when(F.get(matches, i) >= 0, merge(item, F.get(new, F.get(matches, i)))).otherwise(item),
    )
    return F.concat(kept, F.filter(new, lambda _x, i: ~F.array_contains(matches, i)))
