"""Empty-value tests and the field-level merge rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitalake.functions import arrays as A


def is_blank(value: Column) -> Column:
    """Null or ''. The number 0 of a typed column is a value here (zero rule T1)."""
    return value.isNull() | (value == "")


def filled(value: Column) -> Column:
    return ~is_blank(value)


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor '' (trim not applied)."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in values])


def truthy(value: Column, kind: str) -> Column:
    """Blank strings, empty collections, zero, false and null are false."""
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind in ("array", "map"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "number":
        return F.coalesce(value != 0, F.lit(False))
    raise ValueError(f"unknown kind {kind}")


def candidate_field(existing: Column, new: Column, manual: bool = False) -> Column:
    """M6: empty new is skipped, empty existing is filled, a manual edit wins, else the longer text."""
    if manual:
        return F.when(filled(new), new).otherwise(existing)
    take = filled(new) & (is_blank(existing) | (F.length(new) > F.length(existing)))
    return F.when(take, new).otherwise(existing)


def candidate_number(existing: Column, new: Column, manual: bool = False) -> Column:
    """M6 for numbers: 0 counts as empty, otherwise the longer printed form wins."""
    has_new = F.coalesce(new != 0, F.lit(False))
    if manual:
        return F.when(has_new, new).otherwise(existing)
    none = F.coalesce(existing == 0, F.lit(True))
    longer = F.length(new.cast("string")) > F.length(existing.cast("string"))
    return F.when(has_new & (none | longer), new).otherwise(existing)


LOCATION_PARTS = ["city", "state", "country", "fullAddress"]


def location_struct(existing: Column, new: Column, manual: bool = False) -> Column:
    """M7: a manual edit replaces every part, otherwise each part keeps the longer text."""
    def part(name: str) -> Column:
        if manual:
            return F.coalesce(new[name], F.lit("")).alias(name)
        return F.coalesce(candidate_field(existing[name], new[name]), F.lit("")).alias(name)

    return F.struct(*[part(name) for name in LOCATION_PARTS])


def location_from_text(text: Column) -> Column:
    """M7: free text becomes city and full address."""
    value = F.coalesce(F.trim(text), F.lit(""))
    return F.struct(value.alias("city"), F.lit("").alias("state"), F.lit("").alias("country"), value.alias("fullAddress"))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def richer_text(new: Column, existing: Column) -> Column:
    """M8: more than 1.2 times the words or 1.5 times the characters."""
    return (
        F.when(is_blank(existing), filled(new))
        .when(is_blank(new), F.lit(False))
        .otherwise(
            (word_count(new) > word_count(existing) * 1.2) | (F.length(new) > F.length(existing) * 1.5)
        )
    )


def richer_list(new: Column, existing: Column) -> Column:
    """M8 for lists: more items."""
    return F.coalesce(F.size(new), F.lit(0)) > F.coalesce(F.size(existing), F.lit(0))


def fill_gap(existing: Column, new: Column) -> Column:
    """An existing non-empty text always wins."""
    return F.coalesce(F.nullif(existing, F.lit("")), new)


def merge_by_strategy(existing: Column, new: Column, strategy: str) -> Column:
    """M13 for texts: ``questionnaire_wins`` and ``merge`` keep existing, ``extracted_wins`` replaces it."""
    if strategy in ("questionnaire_wins", "merge"):
        return first_filled(existing, new)
    if strategy == "extracted_wins":
        return first_filled(new, existing)
    raise ValueError(f"unknown strategy {strategy}")


def merge_lists_by_strategy(existing: Column, new: Column, strategy: str) -> Column:
    """M13 for lists: whole-list choice, or new items appended when absent."""
    if strategy == "merge":
        return A.append_absent(existing, new)
    if strategy == "questionnaire_wins":
        return F.when(F.size(existing) > 0, existing).otherwise(new)
    if strategy == "extracted_wins":
        return F.when(F.size(new) > 0, new).otherwise(existing)
    raise ValueError(f"unknown strategy {strategy}")


def merge_preferring(existing: Column, new: Column, prefer_new: bool) -> Column:
    """Fill empty; otherwise the flag decides."""
    return first_filled(new, existing) if prefer_new else first_filled(existing, new)
