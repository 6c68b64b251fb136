"""Validators and scores over profile records.

Every validator is a set of expressions over one record's own columns, so
validation never shuffles. Zero years count as a value where the rule tests
presence of a typed field (T1) and as empty where the rule tests truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import arrays as A, rules as R, values as V
from vitalake.functions.rules import Rule
from vitalake.functions.windows import previous_row
from vitalake.sources.dims import SETTINGS

# Fixed values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SECTION_WEIGHTS = {"candidate": 0.30, "experience": 0.40, "skills": 0.20, "education": 0.10}
GENERIC_PHRASES = ["hard worker", "team player", "fast learner"]
UNPROFESSIONAL_WORDS = ["basically", "stuff", "things", "whatever"]
WEAK_VERBS = ["worked on", "responsible for", "helped with", "did", "was part of", "involved in", "assisted"]
VAGUE_TERMS = ["various", "multiple", "several", "many", "some", "stuff", "things", "etc", "and so on"]
QUANTIFIED = (
    r"\d+%|\$\d+|\d+x|\d+\s*hours?|\d+\s*days?|\d+\s*users?|\d+\s*teams?|\d+\s*projects?"
)
ACHIEVEMENT_WORDS = ["achieved", "improved", "increased", "reduced", "delivered"]
TITLE_LEAD_WORDS = ["lead", "senior", "principal", "architect", "manager"]
LEAD_VERBS = ["led", "managed", "mentored", "coordinated"]
TEN_SECTIONS = [
    "personal_details", "summary", "skills", "experience", "project_experience", "education", "certifications",
    "publications", "awards", "languages",
]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _size(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0))


def _blank(name: str) -> Column:
    return V.is_blank(F.col(name))


def _list_or_empty(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else A.empty("string")


def contains_any(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


# --- V1, V2, A11: export readiness ------------------------------------------------------------


def section_scores(df: DataFrame) -> dict[str, Column]:
    """V2: points of the four sections, each at most 100."""
    def points(value: int, *tests: Column) -> Column:
        total = F.lit(0)
        for t in tests:
            total = total + F.when(t, value).otherwise(0)
        return total

    def has(name: str) -> Column:
        return ~_blank(name)

    candidate = (
        points(20, has("full_name"), has("phone"), has("email"))
        + points(20, has("city") & has("country"))
        + points(7, has("summary"), F.col("years").isNotNull(), has("organization"))
    )
    experience = points(50, _size("work") > 0, _size("projects") > 0) + points(10, _size("work") > 1, _size("projects") > 1)
    skill_lists = ["primary_skills", "secondary_skills", "technical_skills", "functional_skills", "tools"]
    skills = points(20, *[F.size(_list_or_empty(df, n)) > 0 for n in skill_lists])
    detailed = F.size(F.filter(F.slice("education", 1, 2), lambda e: (e["degree"] != "") & (e["institution"] != "")))
    education = F.when(_size("education") == 0, 0).otherwise(60 + points(20, _size("education") > 1) + detailed * 10)
    hundred = F.lit(100)
    return {
        "candidate": F.least(hundred, candidate), "experience": F.least(hundred, experience),
        "skills": F.least(hundred, skills), "education": F.least(hundred, education),
    }


def completeness(df: DataFrame) -> Column:
    """Weighted section points, 0 to 100."""
    scores = section_scores(df)
    total = F.lit(0.0)
    for name, weight in SECTION_WEIGHTS.items():
        total = total + scores[name] * weight
    return F.round(F.least(F.lit(100.0), total), 6)


MANDATORY = {"full_name": "Full Name", "phone": "Phone Number", "email": "Email", "city": "City", "country": "Country"}


def _missing(labels: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in labels.items()]))


def missing_mandatory() -> Column:
    return _missing({label: _blank(name) for name, label in MANDATORY.items()})


def missing_recommended(df: DataFrame) -> Column:
    return _missing(
        {
            "Summary": _blank("summary"), "Total Experience Years": F.col("years").isNull(),
            "Current Organization": _blank("organization"), "Current Designation": _blank("title"),
            "Primary Skills": _size("primary_skills") == 0,
            "Technical Skills": F.size(_list_or_empty(df, "technical_skills")) == 0,
        }
    )


def validate(df: DataFrame, operation: str = "save") -> DataFrame:
    """V1: readiness of each record for ``save``, ``save_and_validate`` or ``export``."""
    base = df.withColumns(
        {"completeness": completeness(df), "missing_mandatory": missing_mandatory(), "missing_recommended": missing_recommended(df)}
    )
    full = F.size("missing_mandatory") == 0
    ready = F.col("completeness") >= 70
    no_experience = (_size("work") == 0) & (_size("projects") == 0)
    low = F.col("completeness") < (50 if operation == "save" else 40)
    none = A.empty("string")

    def notes(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in pairs]))

    if operation == "save":
        errors, warnings = none, notes((~full, "fields to fill before export"), (low, "under half complete"))
        can_export = full
    elif operation == "save_and_validate":
        errors = none
        no_skills = F.lit(True)
        for name in ("primary_skills", "secondary_skills", "technical_skills", "functional_skills"):
            no_skills = no_skills & (F.size(_list_or_empty(df, name)) == 0)
        warnings = notes(
            (no_experience, "neither work nor projects"), (no_skills, "no skill list is filled"), (_size("education") == 0, "education is empty"),
            (~full, "not ready for export"), (F.size("missing_recommended") > 0, "optional fields are open"),
        )
        can_export = full
    elif operation == "export":
        errors = notes((~full, "fields to fill before export"), (no_experience, "neither work nor projects"), (low, "under 40 percent complete"))
        warnings = none
        can_export = F.size(errors) == 0
    else:
        raise ValueError(f"unknown operation {operation}")
    out = base.withColumns({"errors": errors, "warnings": warnings}).withColumn("can_export", can_export)
    return out.select(
        "cv_id", F.lit(operation).alias("operation"), "completeness", "missing_mandatory", "missing_recommended", "errors",
        "warnings", F.lit(True).alias("can_save"), "can_export", (F.col("can_export") & ready).alias("export_ready"),
        F.try_element_at("errors", F.lit(1)).alias("blocked_reason"),
    )


def session_score(result: DataFrame) -> DataFrame:
    """V3: score and confidence of a validation result for storage with the session."""
    errors, warnings = F.size("errors"), F.size("warnings")
    confidence = F.greatest(F.lit(0.0), F.col("completeness") / 100 - errors * 0.1 - warnings * 0.05)
    return result.withColumns(
        {
            "score": F.round(F.greatest(F.lit(0.0), F.col("completeness") - errors * 15 - warnings * 5), 6),
            "confidence": F.round(confidence, 6),
            "leadership_confidence": F.round(F.greatest(F.lit(0.4), confidence), 6),
        }
    )


def confidence_warnings(scores: Column, overall: Column) -> Column:
    """V4: one warning for a low overall confidence and one per low field, in field order."""
    fields = F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: (k != "overall") & (v < 0.5))))
    per_field = F.transform(fields, lambda k: F.concat(F.lit("low confidence: "), k))
    head = F.when(overall < 0.6, F.array(F.lit("low overall confidence"))).otherwise(A.empty("string"))
    return F.concat(head, per_field)


def export_eligible(df: DataFrame) -> DataFrame:
    """may this session be exported, and if not, why.

    Needs resolved_cv, canonical_cv, can_export, errors and (optional) review_status.
    """
    cv = V.first_filled(F.col("resolved_cv"), F.col("canonical_cv"))
    first_errors = F.array_join(F.slice("errors", 1, 3), "; ")
    reason = (
        F.when(cv.isNull(), "no canonical record")
        .when(~F.coalesce("can_export", F.lit(False)), F.when(F.size("errors") > 0, first_errors).otherwise("not validated"))
        .when(F.col("review_status").isNotNull() & (F.col("review_status") != "approved"), "review not completed")
    )
    return df.withColumns({"eligible": reason.isNull(), "reason": reason})


# --- rule-table validators --------------------------------------------------------------------


def _valid_email() -> Column:
    return _text("email").rlike(EMAIL)


def _has_digit_count(low: int, high: int, strip: str) -> Column:
    clean = F.regexp_replace(_text("phone"), strip, "")
    return clean.rlike(r"^[0-9]+$") & F.length(clean).between(low, high)


def rule_table_issues(df: DataFrame) -> DataFrame:
    """V5: eleven rules with score deductions by level."""
    shown = F.expr("transform(flatten(transform(projects, x -> x.technologies)), t -> lower(t))")
    unmatched = F.filter(F.slice("primary_skills", 1, 3), lambda s: ~F.array_contains("_shown", F.lower(s)))
    base = df.withColumn("_shown", shown).withColumn("_unmatched", unmatched)
    name = _text("full_name")
    rules = [
        Rule("required_full_name", "completeness", "critical", "full_name", "no full name", F.trim(name) == ""),
        Rule("required_email", "completeness", "critical", "email", "no e-mail address", F.trim(_text("email")) == ""),
        Rule("required_contact", "completeness", "critical", "phone", "no phone number", F.trim(_text("phone")) == ""),
        Rule("required_skills", "completeness", "error", "skills", "no skill named", _size("primary_skills") == 0),
        Rule("email_format", "format", "error", "email", "e-mail address is malformed", ~_blank("email") & ~_valid_email()),
        Rule("phone_format", "format", "warning", "phone", "phone number has too few or too many digits",
             ~_blank("phone") & ~_has_digit_count(10, 12, "[- ()]")),
        Rule("experience_years", "business_rule", "warning", "years", "years of experience above 50",
             F.abs("years") > 50),
        Rule("minimum_education", "business_rule", "warning", "education", "no education entry",
             _size("education") == 0),
        Rule("name_quality", "data_quality", "warning", "full_name", "name has signs other than letters",
             (name != "") & name.rlike(r"[^a-zA-Z\s.\-]")),
        Rule("summary_quality", "data_quality", "info", "summary", "summary under 50 characters",
             ~_blank("summary") & (F.length("summary") < 50)),
        Rule("skills_project_alignment", "cross_field", "warning", "skills",
             F.concat(F.lit("skills that no project shows: "), F.array_join("_unmatched", ", ")),
             (_size("projects") > 0) & (F.size("_unmatched") > 0)),
    ]
    out = base.select("*", R.record_issues(rules).alias("issues"))
    weights = {"critical": 0.3, "error": 0.2, "warning": 0.1, "info": 0.05}
    return out.select(
        "cv_id", "issues", (R.level_count(F.col("issues"), "critical") == 0).alias("is_valid"),
        F.bround(F.greatest(F.lit(0.0), 1.0 - R.weighted(F.col("issues"), weights)), 2).alias("score"),
    )


def apply_fixes(df: DataFrame, fixes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """V6: write ``(condition, value)`` per field where the condition holds."""
    return df.withColumns({name: F.when(test, value).otherwise(F.col(name)) for name, (test, value) in fixes.items()})


def staged_issues(df: DataFrame) -> DataFrame:
    """V7: structure, completeness, format, quality and wording, in this order."""
    summary = _text("summary")
    low = F.lower(summary)
    has_header = ~(_blank("full_name") & _blank("email") & _blank("phone") & _blank("title"))
    clean = F.regexp_replace(_text("phone"), r"[\s\-()]", "")
    skills = F.concat(F.coalesce("primary_skills", A.empty("string")), F.coalesce("secondary_skills", A.empty("string")))
    base = df.withColumns({"_repeated": A.repeated(skills), "_acronyms": F.size(F.regexp_extract_all("summary", F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))})
    rules = [
        Rule("missing_header", "completeness", "critical", "header", "no header field is filled", ~has_header),
        Rule("missing_summary", "completeness", "critical", "summary", "no summary", summary == ""),
        Rule("missing_skills", "completeness", "critical", "skills", "no primary skill", _size("primary_skills") == 0),
        Rule("missing_work", "completeness", "critical", "work", "no work entry", _size("work") == 0),
        Rule("no_name", "completeness", "error", "full_name", "header lacks the full name", has_header & _blank("full_name")),
        Rule("no_email", "completeness", "error", "email", "header lacks the e-mail address", has_header & _blank("email")),
        Rule("no_phone", "completeness", "error", "phone", "header lacks the phone number", has_header & _blank("phone")),
        Rule("short_summary", "quality", "warning", "summary", "summary under 100 characters",
             (summary != "") & (F.length(summary) < 100)),
        Rule("few_skills", "completeness", "warning", "primary_skills", "under three primary skills", _size("primary_skills") < 3),
        Rule("no_work", "completeness", "error", "work", "work list has no entry", _size("work") == 0),
        Rule("email_format", "format", "error", "email", "e-mail address is malformed", ~_blank("email") & ~_valid_email()),
        Rule("phone_format", "format", "warning", "phone", "phone number is malformed",
             ~_blank("phone") & ~clean.rlike(r"^(\+91)?[0-9]{10}$")),
        *[Rule(f"generic_{i}", "quality", "info", "summary", f"generic phrase: {p}", low.contains(p))
          for i, p in enumerate(GENERIC_PHRASES)],
        Rule("repeated_skills", "quality", "warning", "skills", "a skill is named twice", F.size("_repeated") > 0),
        *[Rule(f"wording_{i}", "professional", "warning", "summary", f"informal word: {w}", low.contains(w))
          for i, w in enumerate(UNPROFESSIONAL_WORDS)],
        Rule("acronyms", "professional", "info", "summary", "over five acronyms", F.col("_acronyms") > 5),
    ]
    fixable = F.filter("issues", lambda x: x["rule"].isin("phone_format", "repeated_skills"))
    return base.select("cv_id", R.record_issues(rules).alias("issues")).withColumn("auto_fixable", F.size(fixable))


def engine_issues(df: DataFrame) -> DataFrame:
    """V8: rule engine with penalties, including word repetition and per-entry richness."""
    summary = _text("summary")
    split_words = F.filter(F.split(F.lower(summary), r"\s+"), lambda w: w != "")
    base = df.withColumn("_words", split_words)
    # most frequent word: longest run in the sorted words, kept as (previous, run, best)
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["w"] == word, acc["run"] + 1).otherwise(1)
        return F.struct(word.alias("w"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    base = base.withColumn("_top", F.aggregate(F.array_sort("_words"), start, step)["best"])
    project_years = F.lit(0.0)
    if "project_years" in df.columns:
        project_years = F.col("project_years")
    clean = F.regexp_replace(_text("phone"), r"[\s\-()]", "")
    no_years = F.coalesce(F.col("years") == 0, F.lit(True))
    rules = [
        Rule("required_full_name", "structural", "error", "full_name", "mandatory field has no value", _blank("full_name")),
        Rule("required_email", "structural", "error", "email", "mandatory field has no value", _blank("email")),
        Rule("required_phone", "structural", "error", "phone", "mandatory field has no value", _blank("phone")),
        Rule("required_years", "structural", "error", "years", "mandatory field has no value", no_years),
        Rule("email_format", "semantic", "error", "email", "e-mail address is malformed", ~_blank("email") & ~_valid_email()),
        Rule("phone_format", "semantic", "warning", "phone", "phone number is malformed",
             ~_blank("phone") & ~(clean.rlike("^[0-9]+$") & (F.length(clean) >= 10))),
        Rule("experience_range", "semantic", "warning", "years", "years of experience above 50", F.abs("years") > 50),
        Rule("few_skills", "business_rule", "warning", "skills", "under three skills", _size("primary_skills") < 3),
        Rule("brief_summary", "data_quality", "suggestion", "summary", "summary under 50 characters",
             F.col("summary").isNotNull() & (F.length(summary) < 50)),
        Rule("repetitive_summary", "data_quality", "info", "summary", "one word makes up a fifth of the summary",
             (F.size("_words") > 10) & (F.col("_top") > F.size("_words") * 0.2)),
        Rule("optional_summary", "completeness", "suggestion", "summary", "optional field has no value", summary == ""),
        Rule("optional_certs", "completeness", "suggestion", "certs", "optional field has no value", _size("certs") == 0),
        Rule("timeline", "consistency", "warning", "projects", "projects last longer than the years of experience",
             ~no_years & (project_years > F.abs("years") * 1.5)),
    ]
    years = R.entry_issues(F.col("education"), "education", lambda e, i: [
        Rule("education_year", "business_rule", "info", "", "education entry without a year", e["year"] == "")])
    thin = R.entry_issues(F.col("projects"), "projects", lambda p, i: [
        Rule("thin_project", "data_quality", "suggestion", ".description", "thin project description",
             F.length(F.coalesce(p["description"], F.lit(""))) < 100)])
    out = base.select("cv_id", F.concat(R.record_issues(rules), years, thin).alias("issues"))
    weights = {"error": 0.25, "warning": 0.10, "info": 0.05, "suggestion": 0.02}
    return out.select(
        "cv_id", "issues", (R.level_count(F.col("issues"), "error") == 0).alias("is_valid"),
        F.round(F.greatest(F.lit(0.0), 1.0 - R.weighted(F.col("issues"), weights)), 6).alias("score"),
    )


def layered_checks(df: DataFrame) -> DataFrame:
    """V9: five levels of pass/fail checks; score = share passed, damped by the worst level.

    Entry texts are work descriptions plus project descriptions and responsibilities.
    """
    texts = F.expr(
        "concat(transform(coalesce(work, array()), w -> coalesce(w.description, '')), "
        "transform(coalesce(projects, array()), p -> concat(coalesce(p.description, ''), ' ', array_join(p.responsibilities, ' '))))"
    )
    plain = F.expr(
        "concat(transform(coalesce(work, array()), w -> lower(coalesce(w.description, ''))), "
        "transform(coalesce(projects, array()), p -> lower(coalesce(p.description, ''))))"
    )
    base = df.withColumns({"_texts": texts, "_plain": plain})
    entries = F.size("_texts")
    weak = F.size(F.filter("_texts", lambda t: A.let(F.lower(t), lambda low: contains_any(low, WEAK_VERBS))))
    vague = F.aggregate(
        "_plain", F.lit(0),
        lambda acc, t: acc + sum((F.when(t.contains(w), 1).otherwise(0) for w in VAGUE_TERMS), F.lit(0)),
    )
    metric = F.size(F.filter("_texts", lambda t: t.rlike(f"(?=[0-9$])(?:{QUANTIFIED})")))  # tried at what it can begin with only
    listed = F.array_distinct(F.transform(F.coalesce("primary_skills", A.empty("string")), lambda s: F.lower(s)))
    used = F.expr("transform(flatten(transform(coalesce(projects, array()), x -> x.technologies)), t -> lower(t))")
    base = base.withColumns({"_listed": listed, "_used": used})
    # the union below has the used ones already: only the others are looked for in the texts
    in_text = F.filter(F.array_except("_listed", "_used"), lambda s: F.exists("_plain", lambda t: t.contains(s)))
    demonstrated = F.size(F.array_union("_used", in_text))
    base = base.withColumns(
        {"_weak": weak, "_vague": vague, "_metric": metric, "_shown": demonstrated, "_n": entries}
    )
    recent = F.lower(F.coalesce(F.get("work", F.lit(0))["designation"], F.lit("")))
    title = F.lower(_text("title"))
    months = F.col("work_months") if "work_months" in df.columns else F.lit(0)
    ordered = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), _size("work") - 1)),
        lambda i: F.coalesce(
            (F.get("work", i - 1)["end_date"] != "") & (F.get("work", i)["start_date"] != "")
            & (F.get("work", i - 1)["end_date"] < F.get("work", i)["start_date"]), F.lit(False)),
    )
    has_header = ~(_blank("full_name") & _blank("email") & _blank("phone") & _blank("title"))
    # (check, level, applies, fails)
    checks = [
        ("has_header", "critical", F.lit(True), ~has_header),
        ("has_summary", "critical", F.lit(True), _blank("summary")),
        ("has_skills", "critical", F.lit(True), _size("primary_skills") == 0),
        ("has_experience", "critical", F.lit(True), _size("work") == 0),
        ("header_name", "critical", F.lit(True), _blank("full_name")),
        ("header_email", "critical", F.lit(True), _blank("email")),
        ("summary_length", "warning", F.lit(True), F.length(_text("summary")) < 100),
        ("strong_verbs", "warning", F.lit(True), F.col("_weak") > F.col("_n") * 0.5),
        ("no_vague_terms", "warning", F.lit(True), F.col("_vague") > 3),
        ("quantified", "warning", F.lit(True), (F.col("_n") > 0) & (F.col("_metric") / F.greatest(F.lit(1), F.col("_n")) < 0.5)),
        ("skills_shown", "warning", F.size("_listed") > 0, F.col("_shown") / F.greatest(F.lit(1), F.size("_listed")) < 0.5),
        ("title_matches", "warning", _size("work") > 0, ~recent.contains(title) & ~title.contains(recent)),
        ("years_match", "error", F.col("years").isNotNull(), F.abs(F.col("years") - months / 12) > 2),
        ("chronological", "error", _size("work") > 1, ordered),
        ("gaps", "info", _size("work") > 1, F.lit(False)),
    ]
    marks = [
        F.when(applies, F.struct(F.lit(n).alias("check"), F.lit(lv).alias("level"), F.coalesce(fails, F.lit(False)).alias("failed")))
        for n, lv, applies, fails in checks
    ]
    out = base.select("cv_id", F.array_compact(F.array(*marks)).alias("checks"))
    failed = F.filter("checks", lambda c: c["failed"])

    def count(level: str) -> Column:
        return F.size(F.filter("failed", lambda c: c["level"] == level))

    out = out.withColumn("failed", failed)
    share = (F.size("checks") - F.size("failed")) / F.size("checks")
    damp = F.when(count("critical") > 0, 0.5).when(count("error") > 0, 0.7).when(count("warning") > 3, 0.9).otherwise(1.0)
    return out.select(
        "cv_id", F.transform("failed", lambda c: c["check"]).alias("failed"),
        ((count("critical") == 0) & (count("error") == 0)).alias("is_valid"), F.round(share * damp, 6).alias("score"),
    )


def impact_report(df: DataFrame) -> DataFrame:
    """Issues with confidence impact and per-section confidence and completeness means."""
    words = V.word_count(F.col("summary"))
    skills = _size("primary_skills") + _size("secondary_skills")
    both = F.transform(
        F.concat(F.coalesce("primary_skills", A.empty("string")), F.coalesce("secondary_skills", A.empty("string"))), lambda s: F.lower(s)
    )
    repeats = F.size(both) != F.size(F.array_distinct(both))
    bad_email = ~_blank("email") & ~_valid_email()
    bad_phone = ~_blank("phone") & ~_text("phone").rlike(r"^[0-9\s\-+()]{10,}$")
    one_word = ~_blank("full_name") & (V.word_count(F.col("full_name")) < 2)

    def hit(test: Column, impact: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), impact).otherwise(0.0)

    def misses(entries: str, test) -> Column:
        return F.size(F.filter(F.coalesce(entries, F.array()), test))

    no_client = misses("projects", lambda p: p["name"] == "")
    no_text = misses("projects", lambda p: F.coalesce(p["description"], F.lit("")) == "")
    work_gap = misses("work", lambda w: (w["organization"] == "") | (w["designation"] == ""))
    no_degree = misses("education", lambda e: e["degree"] == "")
    no_school = misses("education", lambda e: e["institution"] == "")
    base = df.withColumns({
        "_words": words, "_skills": skills, "_no_client": no_client, "_no_text": no_text, "_work_gap": work_gap,
        "_no_degree": no_degree, "_no_school": no_school, "_repeats": repeats,
    })
    none = {n: _size(n) == 0 for n in ("work", "projects", "education")}
    required = [_blank("full_name"), _blank("email"), _blank("phone"), _blank("summary"), _size("primary_skills") == 0]
    critical = sum((F.when(t, 1).otherwise(0) for t in required), F.lit(0))
    impact = (
        critical * 0.3 + hit(bad_email, 0.2) + hit(bad_phone, 0.1) + hit(one_word, 0.1)
        + F.when(_blank("summary"), 0.0).when(F.col("_words") < 20, 0.15).when(F.col("_words") > 150, 0.05).otherwise(0.0)
        + hit(F.col("_skills") < 3, 0.2) + hit(F.col("_repeats"), 0.05)
        + hit(none["work"], 0.2) + F.col("_work_gap") * 0.1
        + hit(none["projects"], 0.15) + F.col("_no_client") * 0.15 + F.col("_no_text") * 0.1
        + hit(none["education"], 0.2) + F.col("_no_degree") * 0.15 + F.col("_no_school") * 0.1
    )
    header = sum((F.when(~_blank(n), 1).otherwise(0) for n in ("full_name", "email", "phone", "title", "city")), F.lit(0)) / 5
    sections = [
        header,
        F.when(_blank("summary"), 0.0).when(F.col("_words") >= 20, 1.0).otherwise(0.5),
        F.least(F.lit(1.0), F.col("_skills") / 5.0),
        F.least(F.lit(1.0), _size("work") / 2.0),
        F.least(F.lit(1.0), _size("projects") / 2.0),
        F.when(none["education"], 0.0).otherwise(1.0),
    ]
    complete = sum(sections, F.lit(0.0)) / len(sections)
    errors = hit(bad_email, 1.0) + F.col("_no_client") + F.col("_no_degree")
    return base.select(
        "cv_id", critical.cast("long").alias("critical_count"), errors.cast("long").alias("error_count"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - impact), 6).alias("confidence_score"),
        F.round(complete, 6).alias("completeness_score"),
        (critical == 0).alias("can_export"), ((critical == 0) & (errors == 0)).alias("overall_valid"),
    )


def chronology_issues(df: DataFrame) -> DataFrame:
    """Entries whose start is after their end, compared as text."""
    bad = F.filter("work", lambda w: (w["start_date"] != "") & (w["end_date"] != "") & (w["start_date"] > w["end_date"]))
    return A.explode_items(df, ["cv_id"], bad, "w").select(
        "cv_id", F.concat(F.lit("start after end: "), "w.start_date", F.lit(" follows "), "w.end_date", F.lit(".")).alias("message")
    )


def quality_rule_issues(df: DataFrame, leadership: Column | None = None) -> DataFrame:
    """Completeness and wording rules; ``leadership`` is a text list tested for measurable impact."""
    rules = [
        Rule("full_name", "completeness", "error", "full_name", "no full name", _blank("full_name")),
        Rule("location", "completeness", "error", "city", "no city", _blank("city")),
        Rule("summary", "completeness", "error", "summary", "no summary", F.trim(_text("summary")) == ""),
        Rule("skills", "completeness", "error", "skills", "no primary skill", _size("primary_skills") == 0),
        Rule("short_summary", "quality", "warning", "summary", "summary of few words",
             (F.trim(_text("summary")) != "") & (V.word_count(F.col("summary")) < 8)),
    ]
    issues = R.record_issues(rules)
    if leadership is not None:
        metric = ["%", "improved", "reduced", "saved", "increased"]
        issues = F.concat(issues, R.entry_issues(leadership, "leadership", lambda t, i: [
            Rule("no_metric", "quality", "warning", "", "no figure or result named", ~contains_any(F.lower(t), metric))]))
    return df.select("cv_id", issues.alias("issues"))


def gap_rows(df: DataFrame) -> DataFrame:
    """Missing fields with severity, including per-entry gaps of work experience."""
    def gap(field: str, level: str, test: Column) -> Rule:
        return Rule("gap", "gap", level, field, "missing", test)

    record = R.record_issues([
        gap("personal_info.email", "high", _blank("email")),
        gap("personal_info.phone", "medium", _blank("phone")),
        gap("personal_info.location", "medium", _blank("city")),
        gap("skills.technical_skills", "high", _size("primary_skills") == 0),
        gap("skills.soft_skills", "medium", _size("secondary_skills") == 0),
        gap("education", "high", _size("education") == 0),
        gap("certifications", "low", _size("certs") == 0),
        gap("projects", "medium", _size("projects") == 0),
    ])
    entries = R.entry_issues(F.col("work"), "work_experience", lambda w, i: [
        gap(".responsibilities", "high", w["description"] == ""), gap(".end_date", "medium", w["end_date"] == "")])
    return A.explode_items(df, ["cv_id"], F.concat(record, entries), "g").select(
        "cv_id", F.col("g.field").alias("field"), F.col("g.level").alias("severity")
    )


def completeness_sections(df: DataFrame) -> DataFrame:
    """Six weighted sections (2,3,3,2,1,1), percentage and level."""
    has = {
        "personal_info": (2, ~(_blank("full_name") & _blank("email") & _blank("phone") & _blank("city"))),
        "skills": (3, _size("primary_skills") > 0), "work_experience": (3, _size("work") > 0),
        "education": (2, _size("education") > 0), "certifications": (1, _size("certs") > 0), "projects": (1, _size("projects") > 0),
    }
    got = sum((F.when(t, w).otherwise(0) for w, t in has.values()), F.lit(0))
    count = sum((F.when(t, 1).otherwise(0) for _, t in has.values()), F.lit(0))
    score = got / 12 * 100
    level = F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("needs_improvement")
    return df.select(
        "cv_id", F.round(score, 2).alias("completeness_score"), count.cast("long").alias("complete_sections"), level.alias("quality_level")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """20/30/25/15/10 points and the detail level."""
    personal = sum((F.when(~_blank(n), 20 / 3).otherwise(0.0) for n in ("full_name", "email", "phone")), F.lit(0.0))
    detailed = F.size(F.filter(F.coalesce("work", F.array()), lambda w: w["description"] != "")) * 3
    work = F.least(F.lit(30), F.least(F.lit(30), _size("work") * 10) + detailed)
    skills = F.when(_size("primary_skills") > 0, 15).otherwise(0) + F.when(_size("secondary_skills") > 0, 10).otherwise(0)
    rest = F.when(_size("education") > 0, 15).otherwise(0) + F.when(_size("projects") > 0, 5).otherwise(0)
    score = personal + work + skills + rest + F.when(_size("certs") > 0, 5).otherwise(0)
    sections = [
        ~(_blank("full_name") & _blank("email") & _blank("phone")), (_size("primary_skills") > 0) | (_size("secondary_skills") > 0),
        _size("work") > 0, _size("education") > 0, _size("projects") > 0, _size("certs") > 0,
    ]
    present = sum((F.when(s, 1).otherwise(0) for s in sections), F.lit(0))
    level = F.when(present >= 4.8, "comprehensive").when(present >= 3.6, "good").when(present >= 2.4, "moderate").otherwise("basic")
    return df.select("cv_id", F.round(F.least(F.lit(100.0), score), 2).alias("quality_score"), level.alias("detail_level"))


def role_required_missing(present: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields of each record's role that it lacks.

    ``present`` is (cv_id, role, fields array), ``required`` the (role, field) dimension.
    """
    per_role = required.groupBy("role").agg(F.sort_array(F.collect_list("field")).alias("_need"))
    return (
        present.join(per_role, "role")
        .select("cv_id", "role", F.explode(F.array_except("_need", "fields")).alias("field"))
    )


def section_presence(sections: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(present names, missing names, percentage) of the ten sections."""
    tests = {name: sections.get(name, F.lit(False)) for name in TEN_SECTIONS}
    have = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    lack = F.array_compact(F.array(*[F.when(~t, F.lit(n)) for n, t in tests.items()]))
    return have, lack, F.round(F.size(have) / len(tests) * 100, 6)


def structure_check(df: DataFrame) -> DataFrame:
    """Missing sections are errors, missing recommended fields warnings; tests the table's columns too."""
    needed = {"experience": "work", "education": "education", "skills": "primary_skills", "summary": "summary"}
    errors = [
        F.lit(f"no section {n}") if c not in df.columns
        else F.when(F.col(c).isNull(), F.lit(f"no section {n}"))
        for n, c in needed.items()
    ]
    errors += [
        F.lit(f"{n} must be a list")
        for n, c in {"experience": "work", "education": "education"}.items()
        if c in df.columns and not dict(df.dtypes)[c].startswith("array")
    ]
    warnings = [
        F.when(_blank(c), F.lit(f"no value in personal_details.{c}")) for c in ("full_name", "email")
    ]
    return df.select("cv_id", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"))


def operational_issues(df: DataFrame) -> DataFrame:
    """The validator that decides on export."""
    rules = [
        Rule("name", "candidate", "error", "full_name", "record without a name", F.trim(_text("full_name")) == ""),
        Rule("title", "candidate", "error", "title", "record without a position", _blank("title")),
        Rule("email", "candidate", "error", "email", "e-mail address without an @", ~_text("email").contains("@")),
        Rule("years", "candidate", "error", "years", "negative years of experience", F.col("years") < 0),
        Rule("experience", "experience", "error", "experience", "neither a project nor a job",
             (_size("work") == 0) & (_size("projects") == 0)),
        Rule("education", "education", "error", "education", "no education entry", _size("education") == 0),
        Rule("no_skills", "skills", "warning", "skills", "no primary skill", _size("primary_skills") == 0),
        Rule("few_skills", "skills", "warning", "skills", "under three primary skills", _size("primary_skills") < 3),
    ]
    fields = [f.name for f in df.schema["projects"].dataType.elementType.fields]
    projects = R.entry_issues(F.col("projects"), "projects", lambda p, i: [
        Rule("project_name", "experience", "error", ".name", "project without a name", p["name"] == ""),
        *([Rule("project_role", "experience", "error", ".role", "Role/designation is required", p["role"] == "")] if "role" in fields else []),
    ])
    education = R.entry_issues(F.col("education"), "education", lambda e, i: [
        Rule("degree", "education", "error", ".degree", "education entry without a degree", e["degree"] == ""),
        Rule("institution", "education", "error", ".institution", "education entry without a school", e["institution"] == ""),
    ])
    out = df.select("cv_id", F.concat(R.record_issues(rules), projects, education).alias("issues"))
    return out.withColumn("can_export", R.level_count(F.col("issues"), "error") == 0)


def scaffold_issues(df: DataFrame) -> DataFrame:
    """Required sections, short summary and the question about few skills."""
    has_header = ~(_blank("full_name") & _blank("email") & _blank("phone") & _blank("title"))
    rules = [
        Rule("header", "structure", "error", "header", "mandatory section is empty", ~has_header),
        Rule("summary", "structure", "error", "summary", "mandatory section is empty", _blank("summary")),
        Rule("skills", "structure", "error", "skills", "mandatory section is empty", _size("primary_skills") == 0),
        Rule("work", "structure", "error", "work", "mandatory section is empty", _size("work") == 0),
        Rule("short_summary", "quality", "warning", "summary", "summary under 100 characters",
             ~_blank("summary") & (F.length("summary") < 50)),
        Rule("ask_skills", "followup", "question", "skills", "Which skills could join the few that are listed?", _size("primary_skills") < 3),
    ]
    return df.select("cv_id", R.record_issues(rules).alias("issues"))


def enhancement_suggestions(df: DataFrame, required: list[str], min_summary: int = 100) -> DataFrame:
    """Suggestions against a role template, by priority and impact."""
    texts = F.expr(
        "concat(transform(coalesce(work, array()), w -> lower(coalesce(w.description, ''))), "
        "transform(coalesce(projects, array()), p -> lower(concat(coalesce(p.description, ''), ' ', array_join(p.responsibilities, ' ')))))"
    )
    base = df.withColumn("_texts", texts)
    achieved = F.size(F.filter("_texts", lambda t: contains_any(t, ACHIEVEMENT_WORDS)))
    types = dict(df.dtypes)
    rows = []

    def suggestion(test: Column, field: str, category: str, priority: str, impact: float) -> None:
        rows.append(F.when(test, F.struct(
            F.lit(field).alias("field"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
            F.lit(impact).alias("impact"))))

    for field in required:
        missing = _size(field) == 0 if types[field].startswith("array") else _blank(field)
        suggestion(missing, field, "completeness", "critical", 0.9)
    suggestion(~_blank("summary") & (F.length("summary") < min_summary), "summary", "content", "high", 0.8)
    suggestion(F.col("primary_skills").isNotNull(), "skills", "structure", "medium", 0.7)
    suggestion(achieved < F.size("_texts"), "experience", "achievements", "high", 0.85)
    suggestion(_blank("full_name") & _blank("email") & _blank("phone"), "header", "structure", "critical", 0.95)
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    out = base.select("cv_id", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("cv_id", "s.*")
    return out.withColumn("priority_rank", rank[F.col("priority")])


def issue_report(issues: DataFrame) -> DataFrame:
    """Issue counts by level, category and rule over all records."""
    return issues.groupBy("category", "level", "rule").agg(F.count(F.lit(1)).alias("issues"))


def recommendations_by_field(issues: DataFrame, levels: list[str]) -> DataFrame:
    """Per record and field the worst issue and how many there are."""
    rank = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level"))
    return issues.groupBy("cv_id", "field").agg(
        F.min_by(F.struct("level", "message"), F.struct(rank, "rule")).alias("w"), F.count(F.lit(1)).alias("related_issues")
    ).select("cv_id", "field", F.col("w.level").alias("priority"), F.col("w.message").alias("action"), "related_issues")


def adjust_confidence(fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Field confidence lowered per issue (critical .5, high .7, medium .85) and when empty (.6).

    ``fields`` is (cv_id, field, confidence, is_empty); an issue belongs to the
    field its path starts with. Issues are counted per record and first path
    part before the join, so the join is one row per field.
    """
    head = F.regexp_extract("field", r"^[^.\[]+", 0)
    counts = issues.groupBy("cv_id", head.alias("field")).agg(
        *[F.count(F.when(F.col("level") == lv, 1)).alias(f"_{lv}") for lv in ("critical", "high", "medium")]
    )
    joined = fields.join(counts, ["cv_id", "field"], "left").fillna(0, ["_critical", "_high", "_medium"])
    value = (
        F.coalesce("confidence", F.lit(0.5)) * F.pow(F.lit(0.5), F.col("_critical")) * F.pow(F.lit(0.7), F.col("_high"))
        * F.pow(F.lit(0.85), F.col("_medium")) * F.when(F.col("is_empty"), 0.6).otherwise(1.0)
    )
    return joined.select("cv_id", "field", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6).alias("confidence"))


def overall_of(fields: DataFrame) -> DataFrame:
    """Mean adjusted confidence per record."""
    return fields.groupBy("cv_id").agg(F.round(F.avg("confidence"), 6).alias("overall"))


def leadership_indicators(texts: Column, leadership: Column | None = None) -> Column:
    """0-3 points for title, leadership section and any leading verb in the entry texts."""
    title = F.when(contains_any(F.lower(_text("title")), TITLE_LEAD_WORDS), 1).otherwise(0)
    section = F.lit(0) if leadership is None else F.when(F.size(leadership) > 0, 1).otherwise(0)
    verbs = F.when(F.exists(texts, lambda t: contains_any(F.lower(t), LEAD_VERBS)), 1).otherwise(0)
    return title + section + verbs


def validation_progress(runs: DataFrame, *, bucket: Column) -> DataFrame:
    """What changed since the record's previous validation run."""
    out = previous_row(
        runs, ["cv_id"], ["run_at", "run_id"], bucket, F.struct("error_count", "warning_count", "score"), "before"
    )
    before = F.col("before")
    return out.where(before.isNotNull()).select(
        "cv_id", "run_id",
        F.greatest(F.lit(0), before["error_count"] - F.col("error_count")).alias("fixed_errors"),
        F.greatest(F.lit(0), before["warning_count"] - F.col("warning_count")).alias("resolved_warnings"),
        F.when(F.col("score") - before["score"] > 0.05, F.round(F.col("score") - before["score"], 6)).alias("score_gain"),
    )


def below_thresholds(df: DataFrame, settings: dict[str, int] = SETTINGS) -> Column:
    """Names of the questionnaire's thresholds that a record misses (words of the summary, number of primary
    skills, words of any project's outcome); a null text or list has none."""
    def words(text: Column) -> Column:
        return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))

    tests = [(words(F.col("summary")) < settings["minimum_summary_word_count"], "minimum_summary_word_count")]
    tests.append((F.coalesce(F.size("primary_skills"), F.lit(0)) < settings["minimum_skill_count"], "minimum_skill_count"))
    if "outcomes" in df.columns:
        least = settings["minimum_business_outcome_word_count"]
        tests.append((F.coalesce(F.exists("outcomes", lambda o: words(o) < least), F.lit(False)), "minimum_business_outcome_word_count"))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
