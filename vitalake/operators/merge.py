"""Record merge and field arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import arrays as A, values as V
from vitalake.operators.sessions import renew
from vitalake.operators.validate import validate

# Arbitration priority of sources, and the precedence of source types.
MANUAL_PRIORITY = {"manual": 4, "voice": 3, "docx": 2, "pdf": 1}
SOURCE_ALIASES = {
    "manual": "manual_edit", "manual_edit": "manual_edit",
    "bot": "bot_conversation", "chat": "bot_conversation", "conversation": "bot_conversation",
    "bot_conversation": "bot_conversation",
    "audio": "audio_upload", "voice": "audio_upload", "audio_upload": "audio_upload",
    "document": "document_upload", "docx": "document_upload", "pdf": "document_upload",
    "document_upload": "document_upload",
}
# Order in which remaining flow stages fill gaps after the base (first filler wins).
FLOW_FILL_ORDER = ["conversation", "document_upload", "audio_record", "audio_upload"]


def _key(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def match_projects(existing: Column, new: Column) -> Column:
    """Index of the greedy partner of each existing project, -1 without one.

    Partners have equal names, or share more than 60 % of their words; a blank name never matches.
    """
    def prepare(item: Column) -> Column:
        return A.let(_key(item["name"]), lambda n: F.struct(n.alias("name"), A.words(n).alias("words")))

    def test(a: Column, b: Column) -> Column:
        filled = (a["name"] != "") & (b["name"] != "")
        return filled & ((a["name"] == b["name"]) | (A.jaccard(a["words"], b["words"]) > 0.6))

    return A.match_greedy(existing, new, prepare, test)


def match_exact(existing: Column, new: Column, first: str, second: str) -> Column:
    """One-to-one match on two filled keys (organization+designation, degree+institution, name+issuer)."""
    def prepare(item: Column) -> Column:
        return F.struct(_key(item[first]).alias("a"), _key(item[second]).alias("b"))

    def test(x: Column, y: Column) -> Column:
        return (x["a"] != "") & (x["b"] != "") & (x["a"] == y["a"]) & (x["b"] == y["b"])

    return A.match_greedy(existing, new, prepare, test)


def merge_project(old: Column, new: Column) -> Column:
    """M9: richer description and responsibilities, joined technologies, other texts newer if not shorter."""
    def newer(name: str) -> Column:
        take = V.filled(new[name]) & (V.is_blank(old[name]) | (F.length(new[name]) >= F.length(old[name])))
        return F.when(take, new[name]).otherwise(old[name]).alias(name)

    return F.struct(
        newer("name"),
        newer("client"),
        F.when(V.richer_text(new["description"], old["description"]), new["description"])
        .otherwise(old["description"]).alias("description"),
        A.union_ignore_case(old["technologies"], new["technologies"]).alias("technologies"),
        F.when(V.richer_list(new["responsibilities"], old["responsibilities"]), new["responsibilities"])
        .otherwise(old["responsibilities"]).alias("responsibilities"),
    )


def merge_entry(fields: list[str]):
    """Entry merge for work, education and certifications: fill empty, else the longer text."""
    def merge(old: Column, new: Column) -> Column:
        return F.struct(*[V.candidate_field(old[f], new[f]).alias(f) for f in fields])
    return merge


WORK_FIELDS = ["organization", "designation", "start_date", "end_date", "description"]
EDUCATION_FIELDS = ["degree", "institution", "year"]
TEXT_FIELDS = ["full_name", "email", "phone", "title", "organization", "summary"]


def merge_profiles(
    existing: DataFrame, incoming: DataFrame, source_type: str, *, key: str = "cv_id", manual: bool | None = None
) -> DataFrame:
    """M5: section-wise merge of two record tables; a record on one side only passes through.

    The tables meet once on the record key; every section is then an expression
    over the two rows.
    """
    if manual is None:
        manual = SOURCE_ALIASES.get(source_type, source_type) == "manual_edit"
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def o(name: str) -> Column:
        return F.col(f"o.{name}")

    def n(name: str) -> Column:
        return F.col(f"n.{name}")

    types = dict(existing.dtypes)

    def both(name: str) -> tuple[Column, Column]:
        none = F.array().cast(types[name])
        return F.coalesce(o(name), none), F.coalesce(n(name), none)

    def matched(name: str, merger) -> Column:
        return A.outer_merge(*both(name), F.col(f"_{name}"), merger).alias(name)

    # partners are columns of their own so that the merge below reads them instead of matching per item
    partners = joined.withColumns(
        {
            "_projects": match_projects(*both("projects")),
            "_work": match_exact(*both("work"), "organization", "designation"),
            "_education": match_exact(*both("education"), "degree", "institution"),
        }
    )
    return partners.select(
        F.coalesce(o(key), n(key)).alias(key),
        *[V.candidate_field(o(f), n(f), manual).alias(f) for f in TEXT_FIELDS],
        V.candidate_number(o("years"), n("years"), manual).alias("years"),
        V.location_struct(_location(o), _location(n), manual).alias("location"),
        A.union_ignore_case(o("primary_skills"), n("primary_skills")).alias("primary_skills"),
        A.union_ignore_case(o("secondary_skills"), n("secondary_skills")).alias("secondary_skills"),
        A.append_absent(*both("certs")).alias("certs"),
        matched("projects", merge_project),
        matched("work", merge_entry(WORK_FIELDS)),
        matched("education", merge_entry(EDUCATION_FIELDS)),
        F.lit(source_type).alias("source_type"),
        F.struct(
            F.lit("audit.merge").alias("field"), F.lit("merge").alias("new_value"),
            F.lit(source_type).alias("edited_by"), F.lit(f"Merged data from {source_type}").alias("edit_reason"),
        ).alias("merge_edit"),
    )


def update_from_source(state: DataFrame, incoming: DataFrame, source_type: str, *, now: Column, key: str = "cv_id") -> DataFrame:
    """Incoming records merged into stored ones, validated, with a source event, a new time to live and version + 1.

    ``state`` is the record columns plus ``version``; a record that is not stored yet starts at version 1.
    """
    merged = merge_profiles(state, incoming, source_type, key=key).withColumns({"city": F.col("location.city"), "country": F.col("location.country")})
    checked = validate(merged, "save_and_validate").select(key, "completeness", "can_export", "warnings")
    out = merged.join(checked, key).join(state.select(key, F.col("version").alias("_v")), key, "left")
    out = out.withColumns(
        {
            "version": F.coalesce("_v", F.lit(0)), "status": F.lit("active"),
            "source_event": F.struct(F.lit(source_type).alias("source_type"), now.alias("event_at"), F.lit("merge").alias("description")),
        }
    )
    return renew(out, now=now).drop("_v")


def _location(col) -> Column:
    return F.struct(
        F.coalesce(col("city"), F.lit("")).alias("city"), F.lit("").alias("state"),
        F.coalesce(col("country"), F.lit("")).alias("country"),
        F.concat_ws(", ", F.nullif(col("city"), F.lit("")), F.nullif(col("country"), F.lit(""))).alias("fullAddress"),
    )


def merge_extension(existing: Column, new: Column) -> Column:
    """M10 on flattened string maps: an existing non-empty value stays, new keys are added."""
    return F.map_zip_with(
        F.coalesce(existing, F.create_map().cast("map<string,string>")),
        F.coalesce(new, F.create_map().cast("map<string,string>")),
        lambda _k, a, b: F.coalesce(F.nullif(a, F.lit("")), b, a),
    )


# --- arbitration between several sources -----------------------------------------------------


def field_candidates(sources: dict[str, DataFrame], paths: list[str], *, key: str = "cv_id") -> DataFrame:
    """One row per (record, path, source) with a value; ``position`` is the source order."""
    parts = []
    for position, (source, df) in enumerate(sources.items()):
        pairs = F.array(*[F.struct(F.lit(p).alias("field_path"), F.col(p).cast("string").alias("value")) for p in paths])
        parts.append(
            df.select(key, "confidence", "captured_at", F.explode(pairs).alias("f"))
            .select(key, "f.*", "confidence", "captured_at",
                    F.lit(source).alias("source"), F.lit(position).alias("position"))
            .where("value IS NOT NULL AND value <> ''")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def arbitrate(candidates: DataFrame, strategy: str = "highest_confidence", *, key: str = "cv_id") -> DataFrame:
    """Winner per (record, path); ties go to the earlier source. Default confidence is 0.5."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    pairs = [x for name, rank in MANUAL_PRIORITY.items() for x in (F.lit(name), F.lit(rank))]
    measure = {
        "highest_confidence": confidence,
        "most_complete": V.word_count(F.col("value")),
        "newest": F.col("captured_at"),
        "manual_priority": F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0)),
    }[strategy]
    picked = F.max_by(
        F.struct("value", "source", confidence.alias("confidence"), "position"), F.struct(measure, -F.col("position"))
    )
    return candidates.groupBy(key, "field_path").agg(picked.alias("w"), F.count(F.lit(1)).alias("candidates")).select(
        key, "field_path", "w.*", "candidates"
    )


def conflict_report(candidates: DataFrame, winners: DataFrame, *, key: str = "cv_id") -> DataFrame:
    """Fields whose best other candidate is within 0.1 or has another text."""
    won = winners.select(
        key, "field_path", F.col("value").alias("selected"), F.col("source").alias("selected_source"),
        F.col("confidence").alias("selected_confidence"), F.col("position").alias("_won"),
    )
    others = candidates.join(won, [key, "field_path"]).where(F.col("position") != F.col("_won"))
    near = F.coalesce("confidence", F.lit(0.5)) > F.col("selected_confidence") - 0.1
    unlike = F.lower("value") != F.lower("selected")
    return (
        others.groupBy(key, "field_path", "selected", "selected_source")
        .agg(F.max(near).alias("close_confidence"), F.max(unlike).alias("other_text"))
        .where("close_confidence OR other_text")
    )


def consensus_vote(candidates: DataFrame, *, key: str = "cv_id") -> DataFrame:
    """Modal value, its share, the adjusted mean confidence, and whether (and why) a person should verify it.

    A field is to be verified for ``confidence`` below 0.7, else ``consensus`` below 0.5, else fewer than two ``results``.
    Votes are counted per value first, so the second step sees one row per distinct value.
    """
    per_value = candidates.groupBy(key, "field_path", "value").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("confidence").alias("conf"), F.min("position").alias("first_seen")
    )
    out = per_value.groupBy(key, "field_path").agg(
        F.max_by("value", F.struct("votes", -F.col("first_seen"))).alias("value"),
        F.max("votes").alias("top"), F.sum("votes").alias("total"), F.sum("conf").alias("conf"),
    )
    consensus = F.col("top") / F.col("total")
    mean = F.col("conf") / F.col("total")
    adjusted = F.when(consensus > 0.5, F.least(F.lit(1.0), mean * (1 + 0.2 * consensus))).otherwise(mean)
    reason = F.when(adjusted < 0.7, "confidence").when(consensus < 0.5, "consensus").when(F.col("total") < 2, "results")
    return out.select(
        key, "field_path", "value", F.round(consensus, 6).alias("consensus"), F.round(adjusted, 6).alias("confidence"),
        reason.isNotNull().alias("needs_verification"), reason.alias("verification_reason"),
    )


def resolve_flow_stages(stages: DataFrame, fields: list[str]) -> DataFrame:
    """Base stage (active, else last written) with gaps filled by the other stages in fixed order.

    ``stages`` is (session_id, flow, is_active, written_at, fields...), one row
    per session and flow; the per-field pick is a map-side combined ``min_by``.
    """
    latest = F.struct(F.col("is_active").cast("int"), "written_at", "flow")
    base = stages.groupBy("session_id").agg(F.max_by("flow", latest).alias("base_flow"))
    order = F.array(*[F.lit(x) for x in FLOW_FILL_ORDER])
    ranked = stages.join(base, "session_id").withColumn(
        "_rank", F.when(F.col("flow") == F.col("base_flow"), 0).otherwise(F.array_position(order, F.col("flow")))
    )
    picks = [F.min_by(F.nullif(f, F.lit("")), F.when(F.col(f) != "", F.col("_rank"))).alias(f) for f in fields]
    return ranked.groupBy("session_id").agg(F.first("base_flow").alias("base_flow"), *picks)


# --- duplicates ------------------------------------------------------------------------------


def first_wins(items: Column, keys: list[str]) -> Column:
    """W5 inside a record: first item per normalised key, items with all keys blank dropped."""
    def key(x: Column) -> Column:
        parts = [_key(x[k].cast("string")) for k in keys]
        return F.when(F.concat(*parts) == "", "").otherwise(F.concat_ws("\u0001", *parts))

    return A.keep_first(items, key)


def first_wins_rows(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """W5 over a table: lowest ``order_by`` row per normalised key, as a map-side combined ``min_by``."""
    norm = [_key(F.col(k).cast("string")).alias(f"_k{i}") for i, k in enumerate(keys)]
    filled = F.concat(*[_key(F.col(k).cast("string")) for k in keys]) != ""
    return (
        df.where(filled).groupBy(*norm)
        .agg(F.min_by(F.struct(*df.columns), order_by).alias("row"), F.count(F.lit(1)).alias("copies"))
        .select("row.*", "copies")
    )


def merge_duplicate_entries(
    items: DataFrame, keys: list[str], *, list_field: str = "responsibilities", union_field: str = "technologies",
    text_field: str | None = "description", record: str = "cv_id", ordinal: str = "ordinal",
) -> DataFrame:
    """Entries of one record with equal keys become one.

    Keeps the first spelling, the longest list, the longest text and the
    distinct union (first-seen order). An entry with a blank first key is dropped.
    """
    norm = [_key(F.col(k)) for k in keys]
    cut = items.where(norm[0] != "").withColumns({f"_k{i}": k for i, k in enumerate(norm)})
    group = [record, *[f"_k{i}" for i in range(len(keys))]]
    first = F.struct(*keys)
    aggs = [
        F.min_by(first, ordinal).alias("_first"),
        F.min(ordinal).alias(ordinal),
        F.max_by(list_field, F.struct(F.size(list_field), -F.col(ordinal))).alias(list_field),
        F.array_distinct(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, union_field))), lambda s: s[union_field]))
        ).alias(union_field),
    ]
    if text_field:
        aggs.append(F.max_by(text_field, F.struct(F.length(text_field), -F.col(ordinal))).alias(text_field))
    merged = cut.groupBy(*group).agg(*aggs)
    rest = [c for c in merged.columns if not c.startswith("_") and c != record]
    return merged.select(record, "_first.*", *rest)


def restore_from_snapshots(records: DataFrame, fields: list[str], *, snapshots: str = "snapshots") -> DataFrame:
    """Empty fields (blank text, empty list, null) take the first snapshot's value that is not empty.

    ``snapshots`` is an array of structs with the same fields, oldest first; a null or empty array restores nothing.
    """
    types = dict(records.dtypes)

    def there(value: Column, name: str) -> Column:
        return F.coalesce(F.size(value) > 0, F.lit(False)) if types[name].startswith("array") else F.coalesce(F.trim(value) != "", F.lit(False))

    def restored(name: str) -> Column:
        past = F.filter(F.transform(snapshots, lambda s: s[name]), lambda x: there(x, name))
        return F.when(there(F.col(name), name), F.col(name)).otherwise(F.coalesce(F.get(past, F.lit(0)), F.col(name)))

    return records.withColumns({name: restored(name) for name in fields})
