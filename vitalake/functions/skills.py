"""Skill, role and level categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitalake.functions import arrays as A


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def detect_role_category(title: Column, ai_frameworks: Column) -> Column:
    """Role category from title words, tested in this order (substrings, T9)."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(contains_any(t, ["ai", "ml", "machine learning", "data scientist"]),
               F.when(ai_frameworks > 2, "ai_ml_engineer").otherwise("data_scientist"))
        .when(t.contains("architect"), "solution_architect")
        .when(contains_any(t, ["lead", "principal", "staff"]), "technical_lead")
        .when(contains_any(t, ["devops", "sre", "infrastructure"]), "devops_engineer")
        .when(contains_any(t, ["manager", "director", "vp", "head"]), "manager")
        .otherwise("software_engineer")
    )


def detect_level(years: Column, indicators: Column) -> Column:
    """Level from years of experience and leadership points."""
    return (
        F.when((years >= 10) & (indicators >= 3), "executive")
        .when((years >= 7) | (indicators >= 2), "advanced")
        .when(years >= 3, "intermediate")
        .otherwise("basic")
    )
