"""Schema mapping and record projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import text as T
from vitalake.functions.windows import previous_row
from vitalake.operators.channels import REGISTRY
from vitalake.operators.merge import SOURCE_ALIASES

# Roots that a reviewer may map an attribute to.
ALLOWED_ROOTS = ["candidate", "skills", "experience", "education", "certifications", "personalDetails"]


def get_path(document: Column, path: str) -> Column:
    """Text at a dotted path of a VARIANT; '' and [] count as missing, 0 does not."""
    value = F.try_variant_get(document, "$." + path, "string")
    return F.when(~value.isin("", "[]"), value)


def map_to_canonical(df: DataFrame, registry: dict[str, tuple[list[str], str | None]] | None = None, *, document: str = "payload") -> DataFrame:
    """M1: per canonical path the first filled source name of a JSON text column, else the default, else ''."""
    held = df.withColumn("_v", F.try_parse_json(document))
    columns = {
        path: F.coalesce(*[get_path(F.col("_v"), s) for s in sources], F.lit(default), F.lit(""))
        for path, (sources, default) in (registry or REGISTRY).items()
    }
    # path names hold dots, so the result columns use underscores
    return held.select(*df.columns, *[c.alias(p.replace(".", "_")) for p, c in columns.items()])


def map_list_field(df: DataFrame, sources: list[str], *, document: str = "payload") -> Column:
    """M2: first filled source as a list; a scalar becomes a one-item list, an object is skipped."""
    variant = F.try_parse_json(F.col(document))
    picks = []
    for name in sources:
        node = F.try_variant_get(variant, "$." + name, "variant")
        kind = F.schema_of_variant(node)
        items = F.try_variant_get(variant, "$." + name, "array<string>")
        scalar = F.try_variant_get(variant, "$." + name, "string")
        picks.append(
            F.when(kind.startswith("ARRAY"), F.when(F.size(items) > 0, items))
            .when(~kind.startswith("OBJECT") & (scalar != ""), F.array(scalar))
        )
    return F.coalesce(*picks, F.array().cast("array<string>"))


# Named transforms of the mapping rules
TRANSFORMS = {
    "none": lambda c: c,
    "date": T.normalize_date,
    "location_city": lambda c: T.location_parts(c)["city"],
    "experience_years": lambda c: T.duration_parts(c)["years"].cast("string"),
    "skills": lambda c: F.array_join(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), "|"),
}


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str, bool]], *, document: str = "payload") -> DataFrame:
    """M3: per-channel rules (source, target, transform, mandatory); adds targets and the list of missing mandatory ones."""
    held = df.withColumn("_v", F.try_parse_json(document))
    values = {target: TRANSFORMS[transform](get_path(F.col("_v"), source)) for source, target, transform, _ in rules}
    out = held.select(*df.columns, *[v.alias(t) for t, v in values.items()])
    needed = [t for _, t, _, mandatory in rules if mandatory]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(t), F.lit("")) == "", F.lit(t)) for t in needed])) if needed else F.array().cast("array<string>")
    return out.withColumn("missing_mandatory", missing)


def find_canonical_path(fields: DataFrame, registry: dict | None = None, *, column: str = "source_field") -> DataFrame:
    """M4: canonical path of a source name; the first path that lists it."""
    pairs: dict[str, str] = {}
    for path, (sources, _) in (registry or REGISTRY).items():
        for s in sources:
            pairs.setdefault(s, path)
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return fields.withColumn("canonical_path", F.try_element_at(lookup, F.col(column)))


def canonical_source(source: Column) -> Column:
    """Canonical source type of an alias; an unknown one stays as it is."""
    low = F.lower(F.trim(source))
    lookup = F.create_map(*[F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, low), low)


def apply_edits(fields: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields after the last edit per path, change log with the value before each edit).

    ``fields`` is (cv_id, path, value), ``edits`` (cv_id, path, new_value, edited_by, edited_at, reason). Edits of
    one instant follow by ``id`` where there is one, then by their other columns. The first edit of a path has the field's value before it.
    """
    named = [c for c in ("edited_at", "id") if c in edits.columns]
    order = [*named, *sorted(set(edits.columns) - {"cv_id", "path", *named})]
    last = edits.groupBy("cv_id", "path").agg(F.max_by("new_value", F.struct(*order)).alias("_new"))
    after = fields.join(last, ["cv_id", "path"], "full_outer").select("cv_id", "path", F.coalesce("_new", "value").alias("value"))
    seen = previous_row(edits, ["cv_id", "path"], order, F.date_trunc("day", "edited_at"), F.struct("new_value"), "_before")
    log = seen.join(fields.select("cv_id", "path", F.col("value").alias("_base")), ["cv_id", "path"], "left").withColumn(
        "previous_value", F.when(F.col("_before").isNull(), F.col("_base")).otherwise(F.col("_before.new_value"))).drop("_before", "_base")
    return after, log


def apply_reviewer_mappings(fields: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields after mapping, counts per record, edit log).

    ``mappings`` is (cv_id, ordinal, target_path, value, source, key). Only allowed roots
    with a value apply, the one of the highest ordinal last; text for a skills path becomes a list.
    """
    root = F.substring_index("target_path", ".", 1)
    checked = mappings.withColumn("applied", root.isin(ALLOWED_ROOTS) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    stored = F.when(root == "skills", F.array_join(T.parse_skill_list(F.col("value")), "|")).otherwise(F.trim("value"))
    good = checked.where("applied").select("cv_id", F.col("target_path").alias("path"), stored.alias("_new"), "source", "key", "ordinal")
    one = good.groupBy("cv_id", "path").agg(F.max_by("_new", F.struct("ordinal", "source", "key")).alias("_new"))
    after = fields.join(one, ["cv_id", "path"], "full_outer").select("cv_id", "path", F.coalesce("_new", "value").alias("value"))
    counts = checked.groupBy("cv_id").agg(
        F.count(F.when(F.col("applied"), 1)).alias("applied"), F.count(F.when(~F.col("applied"), 1)).alias("skipped")
    )
    log = good.select("cv_id", F.col("path").alias("field"), F.col("_new").alias("new_value"), F.concat(F.lit("mapped from "), "source", F.lit("."), "key").alias("reason"))
    return after, counts, log


def to_legacy(df: DataFrame) -> DataFrame:
    """Nested canonical record as flat legacy columns."""
    return df.select(
        "cv_id", F.col("candidate.fullName").alias("full_name"), F.col("candidate.email").alias("email"),
        F.col("candidate.phoneNumber").alias("phone"), F.col("candidate.currentDesignation").alias("title"),
        F.col("candidate.currentLocation.city").alias("city"), F.col("skills.primarySkills").alias("primary_skills"),
    )


def to_canonical(df: DataFrame) -> DataFrame:
    """Flat legacy columns as the nested canonical record."""
    return df.select(
        "cv_id",
        F.struct(
            F.col("full_name").alias("fullName"), "email", F.col("phone").alias("phoneNumber"), F.col("title").alias("currentDesignation"),
            F.struct("city", F.coalesce("country", F.lit("")).alias("country")).alias("currentLocation"),
        ).alias("candidate"),
        F.struct(F.col("primary_skills").alias("primarySkills"), F.col("secondary_skills").alias("secondarySkills")).alias("skills"),
    )


def preview_rows(df: DataFrame) -> DataFrame:
    """Flat presentation row of a record; placeholder projects are left out."""
    shown = F.filter("projects", lambda p: ~T.placeholder_project(p))
    return df.select(
        "cv_id", "full_name", F.trim("title").alias("title"), F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("country", F.lit(""))).alias("location"),
        F.when(F.col("years").isNotNull(), F.concat(F.col("years").cast("string"), F.lit(" years"))).otherwise("").alias("experience"),
        F.array_join("primary_skills", ", ").alias("skills"), F.size(shown).alias("projects"), F.size("work").alias("jobs"),
        F.array_join(T.domains_in_text(F.concat_ws(" ", "summary", F.array_join(F.transform("projects", lambda p: p["description"]), " "))), ", ").alias("domains"),
    )


def repair_edits(edits: Column, now: Column) -> Column:
    """Legacy merge entries get field, values, editor, time and reason."""
    return F.transform(
        edits,
        lambda e, i: F.struct(
            F.coalesce(F.nullif(e["field"], F.lit("")), F.concat(F.lit("audit.merge.operation."), (i + 1).cast("string"))).alias("field"),
            F.coalesce(F.nullif(e["new_value"], F.lit("")), F.nullif(e["description"], F.lit("")), e["operation"]).alias("new_value"),
            F.coalesce(F.nullif(e["edited_by"], F.lit("")), F.nullif(e["source_type"], F.lit("")), F.lit("system")).alias("edited_by"),
            F.coalesce(e["edited_at"], now).alias("edited_at"),
            F.coalesce(F.nullif(e["reason"], F.lit("")), F.nullif(e["description"], F.lit("")), F.lit("merge")).alias("reason"),
        ),
    )


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed paths between two flattened states (cv_id, path, value)."""
    joined = before.select("cv_id", "path", F.col("value").alias("_a")).join(
        after.select("cv_id", "path", F.col("value").alias("_b")), ["cv_id", "path"], "full_outer"
    )
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("cv_id", "path", kind.alias("change"))
