"""Rule tables as expressions: each rule is a condition that yields one issue struct."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import arrays as A

ISSUE = "array<struct<rule:string,category:string,level:string,field:string,message:string>>"


class Rule(NamedTuple):
    """``when`` is true where the record breaks the rule."""

    name: str
    category: str
    level: str
    field: str
    message: str | Column
    when: Column


def _issue(rule: Rule, field: Column | None = None) -> Column:
    message = rule.message if isinstance(rule.message, Column) else F.lit(rule.message)
    return F.when(
        F.coalesce(rule.when, F.lit(False)),
        F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.category).alias("category"), F.lit(rule.level).alias("level"),
            (F.lit(rule.field) if field is None else field).alias("field"), message.alias("message"),
        ),
    )


def record_issues(rules: Sequence[Rule]) -> Column:
    """Issues of record-level rules, in rule order."""
    return F.array_compact(F.array(*[_issue(r) for r in rules])).cast(ISSUE)


def entry_issues(entries: Column, path: str, rules: Callable[[Column, Column], Sequence[Rule]]) -> Column:
    """Issues per list entry; the field path is ``path[i]`` followed by the rule's own field."""
    def per_entry(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        return F.array_compact(F.array(*[_issue(r, F.concat(at, F.lit(r.field))) for r in rules(x, i)]))

    return F.flatten(F.transform(F.coalesce(entries, F.array()), per_entry)).cast(ISSUE)


def level_count(issues: Column, level: str) -> Column:
    return F.size(F.filter(issues, lambda x: x["level"] == level))


def weighted(issues: Column, weights: dict[str, float]) -> Column:
    """Sum of weights over the issues' levels."""
    total = F.lit(0.0)
    for level, weight in weights.items():
        total = total + level_count(issues, level) * weight
    return total


def issue_rows(df: DataFrame, column: str = "issues", key: str = "cv_id") -> DataFrame:
    """One row per issue."""
    return A.explode_items(df, [key], F.col(column), "i").select(key, "i.*")
