"""Registered queries: validators and scores over profile records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.functions import rules as R
from vitalake.operators import validate as val
from vitalake.plans import profiles as p, views as v
from vitalake.plans.registry import query
from vitalake.sources import dims

P = "WITH " + p.PROFILES


def _names(column: str = "issues", field: str = "rule"):
    return F.array_join(F.transform(column, lambda x: x[field]), "|").alias(column)


EMAIL_OK = r"regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')"
HEADER = "(full_name <> '' OR email <> '' OR phone <> '' OR title <> '')"
WC = "CASE WHEN trim(summary) = '' THEN 0 ELSE len(regexp_split_to_array(trim(summary), '\\s+')) END"


def _rules(*pairs: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in pairs) + ")"


SCORE_SQL = P + """, pts AS (SELECT *,
  least(100, 20 * ((full_name <> '')::INT + (phone <> '')::INT + (email <> '')::INT) + CASE WHEN city <> '' AND country <> '' THEN 20 ELSE 0 END
    + 7 * ((summary <> '')::INT + (years IS NOT NULL)::INT + (organization <> '')::INT)) AS candidate,
  least(100, 50 * ((len(work) > 0)::INT + (len(projects) > 0)::INT) + 10 * ((len(work) > 1)::INT + (len(projects) > 1)::INT)) AS experience,
  20 * ((len(primary_skills) > 0)::INT + (len(secondary_skills) > 0)::INT) AS skills,
  CASE WHEN len(education) = 0 THEN 0 ELSE least(100, 60 + CASE WHEN len(education) > 1 THEN 20 ELSE 0 END
    + 10 * len(list_filter(education[1:2], lambda e: e.degree <> '' AND e.institution <> ''))) END AS edu,
  concat_ws('|', CASE WHEN full_name = '' THEN 'Full Name' END, CASE WHEN phone = '' THEN 'Phone Number' END, CASE WHEN email = '' THEN 'Email' END,
    CASE WHEN city = '' THEN 'City' END, CASE WHEN country = '' THEN 'Country' END) AS missing_mandatory,
  concat_ws('|', CASE WHEN summary = '' THEN 'Summary' END, CASE WHEN years IS NULL THEN 'Total Experience Years' END,
    CASE WHEN organization = '' THEN 'Current Organization' END, CASE WHEN title = '' THEN 'Current Designation' END,
    CASE WHEN len(primary_skills) = 0 THEN 'Primary Skills' END, 'Technical Skills') AS missing_recommended
  FROM profiles),
sc AS (SELECT *, round(least(100, candidate * 0.3::DOUBLE + experience * 0.4::DOUBLE + skills * 0.2::DOUBLE + edu * 0.1::DOUBLE), 6) AS completeness FROM pts)"""


@query("validate_section_scores", "V2 A11", SCORE_SQL + """
SELECT cv_id, candidate, experience, skills, edu AS education, completeness FROM sc""")
def validate_section_scores(spark, sf):
    df = p.profiles(spark, sf)
    s = val.section_scores(df)
    return df.select("cv_id", *[s[n].cast("long").alias(n) for n in s], val.completeness(df).alias("completeness"))


def _operation(op: str, errors: str, warnings: str, can_export: str) -> None:
    sql = SCORE_SQL + f""", ew AS (SELECT *, {errors} AS errors, {warnings} AS warnings FROM sc), ce AS (SELECT *, {can_export} AS can_export FROM ew)
SELECT cv_id, '{op}' AS operation, completeness, missing_mandatory, missing_recommended, errors, warnings, true AS can_save, can_export,
  can_export AND completeness >= 70 AS export_ready, nullif(split_part(errors, '|', 1), '') AS blocked_reason FROM ce"""

    @query(f"validate_{op}", "V1", sql)
    def run(spark, sf):
        out = val.validate(p.profiles(spark, sf), op)
        joined = {c: F.array_join(c, "|") for c in ("missing_mandatory", "missing_recommended", "errors", "warnings")}
        return out.withColumns(joined)


_operation("save", "''", _rules(("fields to fill before export", "missing_mandatory <> ''"), ("under half complete", "completeness < 50")), "missing_mandatory = ''")
_operation("save_and_validate", "''", _rules(
    ("neither work nor projects", "len(work) = 0 AND len(projects) = 0"), ("no skill list is filled", "len(primary_skills) = 0 AND len(secondary_skills) = 0"),
    ("education is empty", "len(education) = 0"), ("not ready for export", "missing_mandatory <> ''"), ("optional fields are open", "missing_recommended <> ''"),
), "missing_mandatory = ''")
_operation("export", _rules(("fields to fill before export", "missing_mandatory <> ''"), ("neither work nor projects", "len(work) = 0 AND len(projects) = 0"),
                            ("under 40 percent complete", "completeness < 40")), "''", "errors = ''")


@query("validate_session_score", "V3", SCORE_SQL + """,
e AS (SELECT cv_id, completeness, (missing_mandatory <> '')::INT + (len(work) = 0 AND len(projects) = 0)::INT + (completeness < 40)::INT AS n FROM sc)
SELECT cv_id, round(greatest(0, completeness - n * 15), 6) AS score, round(greatest(0.0::DOUBLE, completeness / 100 - n * 0.1::DOUBLE), 6) AS confidence,
  round(greatest(0.4::DOUBLE, completeness / 100 - n * 0.1::DOUBLE), 6) AS leadership_confidence FROM e""")
def validate_session_score(spark, sf):
    out = val.session_score(val.validate(p.profiles(spark, sf), "export"))
    return out.select("cv_id", "score", "confidence", "leadership_confidence")


@query("validate_confidence_warnings", "V4", "WITH " + v.EXTRACTIONS + """,
o AS (SELECT extraction_id, avg(confidence_score) AS overall, string_agg('low confidence: ' || field_path, '|' ORDER BY field_path)
    FILTER (confidence_score < 0.5) AS low FROM field_conf GROUP BY 1)
SELECT extraction_id, concat_ws('|', CASE WHEN overall < 0.6 THEN 'low overall confidence' END, low) AS warnings FROM o""")
def validate_confidence_warnings(spark, sf):
    mean = F.expr("aggregate(map_values(field_confidence), 0D, (a, x) -> a + x) / size(field_confidence)")
    df = v.extractions(spark, sf)
    return df.select("extraction_id", F.array_join(val.confidence_warnings(F.col("field_confidence"), mean), "|").alias("warnings"))


@query("validate_export_eligible", "F14", "WITH " + v.SESSIONS + """,
s AS (SELECT session_id, user_id, errors = 0 AS ok, CASE WHEN user_id % 12 = 0 THEN '' ELSE canonical_cv END AS cv,
  CASE user_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' END AS review,
  [CAST(x AS VARCHAR) FOR x IN generate_series(1, errors)] AS errs FROM sessions),
r AS (SELECT *, CASE WHEN cv = '' THEN 'no canonical record' WHEN NOT ok THEN array_to_string(list_transform(errs[1:3], lambda x: 'error ' || x), '; ')
  WHEN review IS NOT NULL AND review <> 'approved' THEN 'review not completed' END AS reason FROM s)
SELECT session_id, reason IS NULL AS eligible, reason FROM r""")
def validate_export_eligible(spark, sf):
    df = v.sessions(spark, sf).select(
        "session_id", F.lit("").alias("resolved_cv"), F.expr("CASE WHEN user_id % 12 = 0 THEN '' ELSE canonical_cv END").alias("canonical_cv"),
        (F.col("errors") == 0).alias("can_export"),
        F.expr("transform(sequence(1, greatest(1, errors)), x -> concat('error ', x))").alias("errors"),
        F.expr("CASE user_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' END").alias("review_status"),
    )
    return val.export_eligible(df).select("session_id", "eligible", "reason")


SHOWN = "list_transform(flatten(list_transform(projects, lambda x: x.technologies)), lambda t: lower(t))"


@query("validate_rule_table", "V5 J19 P2", P + r""", u AS (SELECT *, """ + SHOWN + """ AS shown FROM profiles),
u2 AS (SELECT *, list_filter(primary_skills[1:3], lambda s: NOT list_contains(shown, lower(s))) AS unmatched,
  regexp_replace(phone, '[- ()]', '', 'g') AS clean FROM u),
i AS (SELECT cv_id, """ + _rules(
    ("required_full_name", "trim(full_name) = ''"), ("required_email", "email = ''"), ("required_contact", "phone = ''"),
    ("required_skills", "len(primary_skills) = 0"), ("email_format", f"email <> '' AND NOT {EMAIL_OK}"),
    ("phone_format", "phone <> '' AND NOT (regexp_matches(clean, '^[0-9]+$') AND length(clean) BETWEEN 10 AND 12)"),
    ("experience_years", "abs(years) > 50"), ("minimum_education", "len(education) = 0"),
    ("name_quality", r"full_name <> '' AND regexp_matches(full_name, '[^a-zA-Z\s.\-]')"),
    ("summary_quality", "summary <> '' AND length(summary) < 50"),
    ("skills_project_alignment", "len(projects) > 0 AND len(unmatched) > 0"),
) + """ AS issues FROM u2)
SELECT cv_id, issues, NOT regexp_matches(issues, 'required_(full_name|email|contact)') AS is_valid,
  round_even(greatest(0.0::DOUBLE, 1 - 0.3::DOUBLE * (contains(issues, 'required_full_name')::INT + contains(issues, 'required_email')::INT + contains(issues, 'required_contact')::INT)
   - 0.2::DOUBLE * (contains(issues, 'required_skills')::INT + contains(issues, 'email_format')::INT)
   - 0.1::DOUBLE * (contains(issues, 'phone_format')::INT + contains(issues, 'experience_years')::INT + contains(issues, 'minimum_education')::INT
     + contains(issues, 'name_quality')::INT + contains(issues, 'skills_project')::INT) - 0.05::DOUBLE * contains(issues, 'summary_quality')::INT), 2) AS score FROM i""")
def validate_rule_table(spark, sf):
    return val.rule_table_issues(p.profiles(spark, sf)).select("cv_id", _names(), "is_valid", "score")


@query("validate_auto_fix", "V6", P + r"""
SELECT cv_id, CASE WHEN phone <> '' THEN regexp_replace(phone, '[- ()]', '', 'g') ELSE phone END AS phone,
  CASE WHEN title <> trim(title) THEN trim(title) ELSE title END AS title FROM profiles""")
def validate_auto_fix(spark, sf):
    fixed = val.apply_fixes(p.profiles(spark, sf), {
        "phone": (F.col("phone") != "", F.regexp_replace("phone", "[- ()]", "")),
        "title": (F.col("title") != F.trim("title"), F.trim("title")),
    })
    return fixed.select("cv_id", "phone", "title")


REPEAT_SQL = "len(list_concat(primary_skills, secondary_skills)) <> len(list_distinct(list_transform(list_concat(primary_skills, secondary_skills), lambda s: lower(s))))"


@query("validate_staged", "V7 U7", P + ", i AS (SELECT cv_id, " + _rules(
    ("missing_header", f"NOT {HEADER}"), ("missing_summary", "summary = ''"), ("missing_skills", "len(primary_skills) = 0"),
    ("missing_work", "len(work) = 0"), ("no_name", f"{HEADER} AND full_name = ''"), ("no_email", f"{HEADER} AND email = ''"),
    ("no_phone", f"{HEADER} AND phone = ''"), ("short_summary", "summary <> '' AND length(summary) < 100"),
    ("few_skills", "len(primary_skills) < 3"), ("no_work", "len(work) = 0"), ("email_format", f"email <> '' AND NOT {EMAIL_OK}"),
    ("phone_format", r"phone <> '' AND NOT regexp_matches(regexp_replace(phone, '[\s\-()]', '', 'g'), '^(\+91)?[0-9]{10}$')"),
    *[(f"generic_{i}", f"contains(lower(summary), '{g}')") for i, g in enumerate(val.GENERIC_PHRASES)],
    ("repeated_skills", REPEAT_SQL),
    *[(f"wording_{i}", f"contains(lower(summary), '{g}')") for i, g in enumerate(val.UNPROFESSIONAL_WORDS)],
    ("acronyms", r"len(list_filter(regexp_split_to_array(summary, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,}'))) > 5"),
) + """ AS issues FROM profiles)
SELECT cv_id, issues, contains(issues, 'phone_format')::INT + contains(issues, 'repeated_skills')::INT AS auto_fixable FROM i""")
def validate_staged(spark, sf):
    return val.staged_issues(p.profiles(spark, sf)).select("cv_id", _names(), "auto_fixable")


ENGINE_SQL = P + """, wd AS (SELECT cv_id, list_filter(regexp_split_to_array(lower(summary), '\\s+'), lambda w: w <> '') AS ws FROM profiles),
top AS (SELECT cv_id, max(n) AS best FROM (SELECT cv_id, w, count(*) AS n FROM (SELECT cv_id, unnest(ws) AS w FROM wd) GROUP BY ALL) GROUP BY 1),
r AS (SELECT p.cv_id, education, projects, """ + _rules(
    ("required_full_name", "full_name = ''"), ("required_email", "email = ''"), ("required_phone", "phone = ''"),
    ("required_years", "coalesce(years, 0) = 0"), ("email_format", f"email <> '' AND NOT {EMAIL_OK}"),
    ("phone_format", r"phone <> '' AND NOT (regexp_matches(regexp_replace(phone, '[\s\-()]', '', 'g'), '^[0-9]+$') AND length(regexp_replace(phone, '[\s\-()]', '', 'g')) >= 10)"),
    ("experience_range", "abs(years) > 50"), ("few_skills", "len(primary_skills) < 3"), ("brief_summary", "length(summary) < 50"),
    ("repetitive_summary", "len(ws) > 10 AND best > len(ws) * 0.2"), ("optional_summary", "summary = ''"), ("optional_certs", "len(certs) = 0"),
) + """ AS head FROM profiles p JOIN wd ON wd.cv_id = p.cv_id LEFT JOIN top ON top.cv_id = p.cv_id),
n AS (SELECT cv_id, head, len(list_filter(education, lambda e: e.year = '')) AS edu, len(list_filter(projects, lambda x: length(x.description) < 100)) AS thin FROM r)
SELECT cv_id, head || repeat('|education_year', edu) || repeat('|thin_project', thin) AS issues,
  NOT regexp_matches(head, 'required_|email_format') AS is_valid,
  round(greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * len(regexp_extract_all(head, 'required_|email_format')) - 0.1::DOUBLE * len(regexp_extract_all(head, 'phone_format|experience_range|few_skills'))
    - 0.05::DOUBLE * (edu + contains(head, 'repetitive')::INT) - 0.02::DOUBLE * (thin + len(regexp_extract_all(head, 'brief_summary|optional_')))), 6) AS score FROM n"""


@query("validate_engine", "V8", ENGINE_SQL.replace("SELECT cv_id, head || repeat", "SELECT cv_id, trim(head || repeat", 1).replace("thin) AS issues", "thin), '|') AS issues", 1))
def validate_engine(spark, sf):
    return val.engine_issues(p.profiles(spark, sf)).select("cv_id", _names(), "is_valid", "score")


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


LAYER_SQL = P + f""", t AS (SELECT *,
  list_concat(list_transform(work, lambda w: w.description), list_transform(projects, lambda x: x.description || ' ' || array_to_string(x.responsibilities, ' '))) AS texts,
  list_concat(list_transform(work, lambda w: lower(w.description)), list_transform(projects, lambda x: lower(x.description))) AS plain,
  list_distinct(list_transform(primary_skills, lambda s: lower(s))) AS listed, {SHOWN} AS used FROM profiles),
c AS (SELECT *, len(texts) AS n, len(list_filter(texts, lambda x: {_any('lower(x)', val.WEAK_VERBS)})) AS weak,
  len(list_filter(plain, lambda x: contains(x, 'various'))) + {' + '.join(f"len(list_filter(plain, lambda x: contains(x, '{w}')))" for w in val.VAGUE_TERMS[1:])} AS vague,
  len(list_filter(texts, lambda x: regexp_matches(x, '{val.QUANTIFIED}'))) AS metric,
  len(list_distinct(list_concat(used, list_filter(listed, lambda s: len(list_filter(plain, lambda x: contains(x, s))) > 0)))) AS shown,
  list_bool_or(list_transform(generate_series(1, len(work) - 1), lambda i: work[i].end_date <> '' AND work[i+1].start_date <> '' AND work[i].end_date < work[i+1].start_date)) AS disorder FROM t),
f AS (SELECT cv_id, 8 + 2 + (len(listed) > 0)::INT + (len(work) > 0)::INT + (years IS NOT NULL)::INT + 2 * (len(work) > 1)::INT AS checks, """ + _rules(
    ("has_header", f"NOT {HEADER}"), ("has_summary", "summary = ''"), ("has_skills", "len(primary_skills) = 0"), ("has_experience", "len(work) = 0"),
    ("header_name", "full_name = ''"), ("header_email", "email = ''"), ("summary_length", "length(summary) < 100"),
    ("strong_verbs", "weak > n * 0.5"), ("no_vague_terms", "vague > 3"), ("quantified", "n > 0 AND metric / n < 0.5"),
    ("skills_shown", "len(listed) > 0 AND shown / len(listed) < 0.5"),
    ("title_matches", "len(work) > 0 AND NOT contains(lower(work[1].designation), lower(title)) AND NOT contains(lower(title), lower(work[1].designation))"),
    ("years_match", "abs(years) > 2"), ("chronological", "len(work) > 1 AND disorder"),
) + """ AS failed FROM c),
g AS (SELECT *, CASE WHEN failed = '' THEN 0 ELSE len(string_split(failed, '|')) END AS k, regexp_matches(failed, 'has_|header_') AS crit,
  regexp_matches(failed, 'years_match|chronological') AS err, len(regexp_extract_all(failed, 'summary_length|strong_verbs|no_vague|quantified|skills_shown|title_matches')) AS warn FROM f)
SELECT cv_id, failed, NOT (crit OR err) AS is_valid,
  round((checks - k) / checks * CASE WHEN crit THEN 0.5::DOUBLE WHEN err THEN 0.7::DOUBLE WHEN warn > 3 THEN 0.9::DOUBLE ELSE 1::DOUBLE END, 6) AS score FROM g"""


@query("validate_layers", "V9 U5", LAYER_SQL)
def validate_layers(spark, sf):
    out = val.layered_checks(p.profiles(spark, sf))
    return out.select("cv_id", F.array_join("failed", "|").alias("failed"), "is_valid", "score")


@query("validate_impact", "V10", P + f""", b AS (SELECT *, {WC} AS wc, len(primary_skills) + len(secondary_skills) AS sk,
  email <> '' AND NOT {EMAIL_OK} AS bad_email, phone <> '' AND NOT regexp_matches(phone, '^[0-9\\s\\-+()]{{10,}}$') AS bad_phone,
  full_name <> '' AND len(regexp_split_to_array(trim(full_name), '\\s+')) < 2 AS one_word,
  len(list_filter(projects, lambda x: x.name = '')) AS nc, len(list_filter(projects, lambda x: x.description = '')) AS nt,
  len(list_filter(work, lambda x: x.organization = '' OR x.designation = '')) AS wg, len(list_filter(education, lambda x: x.degree = '')) AS nd,
  len(list_filter(education, lambda x: x.institution = '')) AS ns, {REPEAT_SQL} AS rep,
  (full_name = '')::INT + (email = '')::INT + (phone = '')::INT + (summary = '')::INT + (len(primary_skills) = 0)::INT AS crit FROM profiles),
d AS (SELECT *, crit * 0.3::DOUBLE + CASE WHEN bad_email THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN bad_phone THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN one_word THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN summary = '' THEN 0 WHEN wc < 20 THEN 0.15::DOUBLE WHEN wc > 150 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN sk < 3 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN rep THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len(work) = 0 THEN 0.2::DOUBLE ELSE 0 END + wg * 0.1::DOUBLE
  + CASE WHEN len(projects) = 0 THEN 0.15::DOUBLE ELSE 0 END + nc * 0.15::DOUBLE + nt * 0.1::DOUBLE
  + CASE WHEN len(education) = 0 THEN 0.2::DOUBLE ELSE 0 END + nd * 0.15::DOUBLE + ns * 0.1::DOUBLE AS impact, (bad_email)::INT + nc + nd AS errs FROM b)
SELECT cv_id, crit AS critical_count, errs AS error_count, round(greatest(0.0::DOUBLE, 1 - impact), 6) AS confidence_score,
  round((((full_name <> '')::INT + (email <> '')::INT + (phone <> '')::INT + (title <> '')::INT + (city <> '')::INT) / 5
    + CASE WHEN summary = '' THEN 0 WHEN wc >= 20 THEN 1 ELSE 0.5::DOUBLE END + least(1, sk / 5) + least(1, len(work) / 2) + least(1, len(projects) / 2)
    + CASE WHEN len(education) = 0 THEN 0 ELSE 1 END) / 6, 6) AS completeness_score, crit = 0 AS can_export, crit = 0 AND errs = 0 AS overall_valid FROM d""")
def validate_impact(spark, sf):
    return val.impact_report(p.profiles(spark, sf))


@query("validate_chronology", "V11 T6", P + """
SELECT cv_id, 'start after end: ' || w.start_date || ' follows ' || w.end_date || '.' AS message
FROM (SELECT cv_id, unnest(work) AS w FROM profiles) WHERE w.end_date <> '' AND w.start_date > w.end_date""")
def validate_chronology(spark, sf):
    return val.chronology_issues(p.profiles(spark, sf))


@query("validate_quality_rules", "V11", P + ", i AS (SELECT cv_id, " + _rules(
    ("full_name", "full_name = ''"), ("location", "city = ''"), ("summary", "trim(summary) = ''"), ("skills", "len(primary_skills) = 0"),
    ("short_summary", f"trim(summary) <> '' AND {WC} < 8"),
) + """ AS head, len(list_filter(lines, lambda l: NOT regexp_matches(lower(l), '%|improved|reduced|saved|increased'))) AS k FROM profiles)
SELECT cv_id, trim(head || repeat('|no_metric', k), '|') AS issues FROM i""")
def validate_quality_rules(spark, sf):
    return val.quality_rule_issues(p.profiles(spark, sf), F.col("lines")).select("cv_id", _names())


GAP_SQL = P + """, g AS (
  SELECT cv_id, 'personal_info.email' AS field, 'high' AS severity FROM profiles WHERE email = ''
  UNION ALL SELECT cv_id, 'personal_info.phone', 'medium' FROM profiles WHERE phone = ''
  UNION ALL SELECT cv_id, 'personal_info.location', 'medium' FROM profiles WHERE city = ''
  UNION ALL SELECT cv_id, 'skills.technical_skills', 'high' FROM profiles WHERE len(primary_skills) = 0
  UNION ALL SELECT cv_id, 'skills.soft_skills', 'medium' FROM profiles WHERE len(secondary_skills) = 0
  UNION ALL SELECT cv_id, 'education', 'high' FROM profiles WHERE len(education) = 0
  UNION ALL SELECT cv_id, 'certifications', 'low' FROM profiles WHERE len(certs) = 0
  UNION ALL SELECT cv_id, 'projects', 'medium' FROM profiles WHERE len(projects) = 0
  UNION ALL SELECT cv_id, 'work_experience[' || (i - 1) || '].end_date', 'medium' FROM (
    SELECT cv_id, unnest(work) AS w, generate_subscripts(work, 1) AS i FROM profiles) WHERE w.end_date = '')"""


@query("validate_gaps", "V12", GAP_SQL + " SELECT * FROM g")
def validate_gaps(spark, sf):
    return val.gap_rows(p.profiles(spark, sf))


@query("validate_completeness_sections", "A12", P + f""", h AS (SELECT cv_id, (full_name <> '' OR email <> '' OR phone <> '' OR city <> '')::INT AS a,
  (len(primary_skills) > 0)::INT AS b, (len(work) > 0)::INT AS c, (len(education) > 0)::INT AS d, (len(certs) > 0)::INT AS e, (len(projects) > 0)::INT AS f FROM profiles)
SELECT cv_id, round((2*a + 3*b + 3*c + 2*d + e + f) / 12 * 100, 2) AS completeness_score, a + b + c + d + e + f AS complete_sections,
  CASE WHEN completeness_score >= 90 THEN 'excellent' WHEN completeness_score >= 70 THEN 'good' WHEN completeness_score >= 50 THEN 'fair' ELSE 'needs_improvement' END AS quality_level FROM h""")
def validate_completeness_sections(spark, sf):
    return val.completeness_sections(p.profiles(spark, sf))


@query("validate_quality_score", "V13", P + """
SELECT cv_id, round(least(100.0::DOUBLE, ((full_name <> '')::INT + (email <> '')::INT + (phone <> '')::INT) * (20 / 3)
  + least(30, least(30, len(work) * 10) + 3 * len(work)) + CASE WHEN len(primary_skills) > 0 THEN 15 ELSE 0 END + CASE WHEN len(secondary_skills) > 0 THEN 10 ELSE 0 END
  + CASE WHEN len(education) > 0 THEN 15 ELSE 0 END + CASE WHEN len(projects) > 0 THEN 5 ELSE 0 END + CASE WHEN len(certs) > 0 THEN 5 ELSE 0 END), 2) AS quality_score,
  CASE WHEN s >= 4.8 THEN 'comprehensive' WHEN s >= 3.6 THEN 'good' WHEN s >= 2.4 THEN 'moderate' ELSE 'basic' END AS detail_level
FROM (SELECT *, (full_name <> '' OR email <> '' OR phone <> '')::INT + (len(primary_skills) > 0 OR len(secondary_skills) > 0)::INT + (len(work) > 0)::INT
  + (len(education) > 0)::INT + (len(projects) > 0)::INT + (len(certs) > 0)::INT AS s FROM profiles)""")
def validate_quality_score(spark, sf):
    return val.quality_score(p.profiles(spark, sf))


ROLE_EXPR = "CASE cv_id % 3 WHEN 0 THEN 'solution_architect' WHEN 1 THEN 'project_manager' ELSE 'common' END"


@query("validate_role_required", "V16", P + f""", r AS (SELECT cv_id, {ROLE_EXPR} AS role, list_concat(
    CASE WHEN email <> '' THEN ['cloud_experience', 'tools_used'] ELSE [] END, CASE WHEN summary <> '' THEN ['business_outcomes', 'methodologies'] ELSE [] END) AS fields FROM profiles)
SELECT cv_id, role, field FROM (SELECT cv_id, role, fields, unnest(string_split(CASE role
  WHEN 'solution_architect' THEN '{" ".join(dims.ROLE_REQUIRED_FIELDS["solution_architect"])}' ELSE '{" ".join(dims.ROLE_REQUIRED_FIELDS["project_manager"])}' END, ' ')) AS field
  FROM r WHERE role <> 'common') WHERE NOT list_contains(fields, field)""")
def validate_role_required(spark, sf):
    present = p.profiles(spark, sf).select(
        "cv_id", F.expr(ROLE_EXPR).alias("role"),
        F.expr("concat(CASE WHEN email <> '' THEN array('cloud_experience', 'tools_used') ELSE CAST(array() AS ARRAY<STRING>) END, "
               "CASE WHEN summary <> '' THEN array('business_outcomes', 'methodologies') ELSE CAST(array() AS ARRAY<STRING>) END)").alias("fields"),
    )
    return val.role_required_missing(present, dims.role_required_fields(spark))


@query("validate_sections_present", "V19 V20", P + """, s AS (SELECT cv_id, concat_ws('|', CASE WHEN full_name <> '' OR email <> '' THEN 'personal_details' END,
  CASE WHEN summary <> '' THEN 'summary' END, CASE WHEN len(primary_skills) > 0 THEN 'skills' END, CASE WHEN len(work) > 0 THEN 'experience' END,
  CASE WHEN len(projects) > 0 THEN 'project_experience' END, CASE WHEN len(education) > 0 THEN 'education' END, CASE WHEN len(certs) > 0 THEN 'certifications' END) AS present,
  concat_ws('|', CASE WHEN full_name = '' THEN 'no value in personal_details.full_name' END, CASE WHEN email = '' THEN 'no value in personal_details.email' END) AS warnings FROM profiles)
SELECT cv_id, present, round(CASE WHEN present = '' THEN 0 ELSE len(string_split(present, '|')) END / 10 * 100, 6) AS share, warnings FROM s""")
def validate_sections_present(spark, sf):
    df = p.profiles(spark, sf)
    have, _, share = val.section_presence({
        "personal_details": (F.col("full_name") != "") | (F.col("email") != ""), "summary": F.col("summary") != "",
        "skills": F.size("primary_skills") > 0, "experience": F.size("work") > 0, "project_experience": F.size("projects") > 0,
        "education": F.size("education") > 0, "certifications": F.size("certs") > 0,
    })
    checked = val.structure_check(df).select("cv_id", F.array_join("warnings", "|").alias("warnings"))
    return df.select("cv_id", F.array_join(have, "|").alias("present"), share.alias("share")).join(checked, "cv_id")


OPER_SQL = P + ", h AS (SELECT cv_id, projects, education, " + _rules(
    ("name", "trim(full_name) = ''"), ("title", "title = ''"), ("email", "NOT contains(email, '@')"), ("years", "years < 0"),
    ("experience", "len(work) = 0 AND len(projects) = 0"), ("education", "len(education) = 0"), ("no_skills", "len(primary_skills) = 0"),
    ("few_skills", "len(primary_skills) < 3"),
) + """ AS head FROM profiles),
k AS (SELECT cv_id, head, repeat('|project_name', len(list_filter(projects, lambda x: x.name = ''))) AS a,
  array_to_string(list_transform(education, lambda e: CASE WHEN e.degree = '' THEN '|degree' ELSE '' END || CASE WHEN e.institution = '' THEN '|institution' ELSE '' END), '') AS b FROM h)
SELECT cv_id, trim(head || a || b, '|') AS issues, trim(replace(replace(head || a || b, 'no_skills', ''), 'few_skills', ''), '|') = '' AS can_export FROM k"""


@query("validate_operational", "V21", OPER_SQL)
def validate_operational(spark, sf):
    return val.operational_issues(p.profiles(spark, sf)).select("cv_id", _names(), "can_export")


@query("validate_scaffold", "V22", P + " SELECT cv_id, " + _rules(
    ("header", f"NOT {HEADER}"), ("summary", "summary = ''"), ("skills", "len(primary_skills) = 0"), ("work", "len(work) = 0"),
    ("short_summary", "summary <> '' AND length(summary) < 50"), ("ask_skills", "len(primary_skills) < 3"),
) + " AS issues FROM profiles")
def validate_scaffold(spark, sf):
    return val.scaffold_issues(p.profiles(spark, sf)).select("cv_id", _names())


@query("validate_enhancements", "V18 O3", P + f""", t AS (SELECT *,
  list_concat(list_transform(work, lambda w: lower(w.description)), list_transform(projects, lambda x: lower(x.description || ' ' || array_to_string(x.responsibilities, ' ')))) AS texts FROM profiles),
s AS (SELECT cv_id, 'email' AS field, 'completeness' AS category, 'critical' AS priority, 0.9::DOUBLE AS impact FROM t WHERE email = ''
  UNION ALL SELECT cv_id, 'summary', 'completeness', 'critical', 0.9::DOUBLE FROM t WHERE summary = ''
  UNION ALL SELECT cv_id, 'primary_skills', 'completeness', 'critical', 0.9::DOUBLE FROM t WHERE len(primary_skills) = 0
  UNION ALL SELECT cv_id, 'summary', 'content', 'high', 0.8::DOUBLE FROM t WHERE summary <> '' AND length(summary) < 100
  UNION ALL SELECT cv_id, 'skills', 'structure', 'medium', 0.7::DOUBLE FROM t
  UNION ALL SELECT cv_id, 'experience', 'achievements', 'high', 0.85::DOUBLE FROM t WHERE len(list_filter(texts, lambda x: {_any('x', val.ACHIEVEMENT_WORDS)})) < len(texts)
  UNION ALL SELECT cv_id, 'header', 'structure', 'critical', 0.95::DOUBLE FROM t WHERE full_name = '' AND email = '' AND phone = '')
SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS priority_rank FROM s""")
def validate_enhancements(spark, sf):
    return val.enhancement_suggestions(p.profiles(spark, sf), ["email", "summary", "primary_skills"])


def _oper_rows(spark, sf):
    return R.issue_rows(val.operational_issues(p.profiles(spark, sf)))


OPER_ROWS = OPER_SQL.replace("SELECT cv_id, trim(head", "ig AS (SELECT cv_id, trim(head", 1).replace("FROM k", "FROM k),\nrw AS (SELECT cv_id, unnest(string_split(issues, '|')) AS rule FROM ig WHERE issues <> '')", 1).replace(
    "FROM h)\nig", "FROM h),\nig")


@query("validate_issue_report", "A13 U6", OPER_ROWS + """
SELECT CASE WHEN rule IN ('name', 'title', 'email', 'years') THEN 'candidate' WHEN rule IN ('experience', 'project_name') THEN 'experience'
  WHEN rule IN ('education', 'degree', 'institution') THEN 'education' ELSE 'skills' END AS category,
  CASE WHEN rule IN ('no_skills', 'few_skills') THEN 'warning' ELSE 'error' END AS level, rule, count(*) AS issues FROM rw GROUP BY ALL""")
def validate_issue_report(spark, sf):
    return val.issue_report(_oper_rows(spark, sf))


@query("validate_recommendations", "A26 O5", GAP_SQL + """
SELECT cv_id, regexp_extract(field, '^[^.\\[]+') AS field, CASE min(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)
  WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, count(*) AS related_issues FROM g GROUP BY cv_id, 2""")
def validate_recommendations(spark, sf):
    gaps = val.gap_rows(p.profiles(spark, sf)).select(
        "cv_id", F.regexp_extract("field", r"^[^.\[]+", 0).alias("field"), F.col("severity").alias("level"), F.col("field").alias("message"),
        F.lit("gap").alias("rule"),
    )
    return val.recommendations_by_field(gaps, ["high", "medium", "low"]).drop("action")


@query("validate_adjusted_confidence", "A17", GAP_SQL + """,
f AS (SELECT cv_id, 'personal_info' AS field, 0.9::DOUBLE AS c, full_name = '' AS e FROM profiles UNION ALL SELECT cv_id, 'skills', 0.8::DOUBLE, len(primary_skills) = 0 FROM profiles
  UNION ALL SELECT cv_id, 'work_experience', NULL, len(work) = 0 FROM profiles),
k AS (SELECT cv_id, regexp_extract(field, '^[^.\\[]+') AS field, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM g GROUP BY ALL)
SELECT f.cv_id, f.field, round(coalesce(c, 0.5::DOUBLE) * pow(0.7, coalesce(h, 0)) * pow(0.85, coalesce(m, 0)) * CASE WHEN e THEN 0.6::DOUBLE ELSE 1 END, 6) AS confidence
FROM f LEFT JOIN k ON k.cv_id = f.cv_id AND k.field = f.field""")
def validate_adjusted_confidence(spark, sf):
    df = p.profiles(spark, sf)
    pairs = F.array(
        F.struct(F.lit("personal_info").alias("field"), F.lit(0.9).alias("confidence"), (F.col("full_name") == "").alias("is_empty")),
        F.struct(F.lit("skills").alias("field"), F.lit(0.8).alias("confidence"), (F.size("primary_skills") == 0).alias("is_empty")),
        F.struct(F.lit("work_experience").alias("field"), F.lit(None).cast("double").alias("confidence"), (F.size("work") == 0).alias("is_empty")),
    )
    fields = df.select("cv_id", F.explode(pairs).alias("f")).select("cv_id", "f.*")
    return val.adjust_confidence(fields, val.gap_rows(df).withColumnRenamed("severity", "level"))


@query("validate_leadership_level", "A25 X27", P + f""", s AS (SELECT cv_id, title, coalesce(abs(years), 0) AS y, {_any('lower(title)', val.TITLE_LEAD_WORDS)}::INT + (len(certs) > 0)::INT
  + (len(list_filter(lines, lambda l: {_any('lower(l)', val.LEAD_VERBS)})) > 0)::INT AS points FROM profiles)
SELECT cv_id, points, CASE WHEN y >= 10 AND points >= 3 THEN 'executive' WHEN y >= 7 OR points >= 2 THEN 'advanced' WHEN y >= 3 THEN 'intermediate' ELSE 'basic' END AS level,
  CASE WHEN regexp_matches(lower(title), 'ai|ml|machine learning|data scientist') THEN 'data_scientist' WHEN contains(lower(title), 'architect') THEN 'solution_architect'
    WHEN regexp_matches(lower(title), 'lead|principal|staff') THEN 'technical_lead' WHEN regexp_matches(lower(title), 'devops|sre|infrastructure') THEN 'devops_engineer'
    WHEN regexp_matches(lower(title), 'manager|director|vp|head') THEN 'manager' ELSE 'software_engineer' END AS category FROM s""")
def validate_leadership_level(spark, sf):
    from vitalake.functions import skills as sk

    df = p.profiles(spark, sf).withColumn("points", val.leadership_indicators(F.col("lines"), F.col("certs")))
    years = F.coalesce(F.abs("years"), F.lit(0))
    return df.select("cv_id", "points", sk.detect_level(years, F.col("points")).alias("level"),
                     sk.detect_role_category(F.col("title"), F.lit(0)).alias("category"))


@query("validate_progress", "W12", "WITH " + v.AUDIT_LOG + """,
r AS (SELECT actor_user_id AS cv_id, id AS run_id, created_at AS run_at, k % 6 AS error_count, k % 4 AS warning_count, (k % 20) / 20.0::DOUBLE AS score FROM audit_log),
l AS (SELECT *, lag(error_count) OVER w AS e, lag(warning_count) OVER w AS a, lag(score) OVER w AS s FROM r WINDOW w AS (PARTITION BY cv_id ORDER BY run_at, run_id))
SELECT cv_id, run_id, greatest(0, e - error_count) AS fixed_errors, greatest(0, a - warning_count) AS resolved_warnings,
  CASE WHEN score - s > 0.05::DOUBLE THEN round(score - s, 6) END AS score_gain FROM l WHERE e IS NOT NULL""")
def validate_progress(spark, sf):
    runs = v.audit_log(spark, sf).selectExpr(
        "actor_user_id AS cv_id", "id AS run_id", "created_at AS run_at", "k % 6 AS error_count", "k % 4 AS warning_count",
        "CAST((k % 20) / 20D AS DOUBLE) AS score",
    )
    return val.validation_progress(runs, bucket=F.date_trunc("day", "run_at"))


@query("validate_questionnaire_thresholds", "V17", "WITH " + p.PROFILES + """,
w AS (SELECT cv_id, len(list_filter(regexp_split_to_array(summary, '\\s+'), lambda x: x <> '')) AS n, len(primary_skills) AS k,
  len(list_filter(list_transform(projects, lambda q: len(list_filter(regexp_split_to_array(q.name, '\\s+'), lambda x: x <> ''))), lambda c: c < 12)) > 0 AS o FROM profiles)
SELECT cv_id, concat_ws('|', CASE WHEN n < 20 THEN 'minimum_summary_word_count' END, CASE WHEN k < 5 THEN 'minimum_skill_count' END,
  CASE WHEN o THEN 'minimum_business_outcome_word_count' END) AS missed FROM w""")
def validate_questionnaire_thresholds(spark, sf):
    records = p.profiles(spark, sf).withColumn("outcomes", F.transform("projects", lambda q: q["name"]))
    return records.select("cv_id", F.array_join(val.below_thresholds(records), "|").alias("missed"))
