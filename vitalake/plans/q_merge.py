"""Registered queries: record merge, duplicates, unmapped attributes, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.functions import arrays as A, values as V
from vitalake.operators import merge, quality, unmapped
from vitalake.plans import profiles as p, views as v
from vitalake.plans.registry import query

P = "WITH " + p.PROFILES
PP = "WITH RECURSIVE " + p.PROFILES + ",\n" + p.PAGE_PROFILES

PAIRS_SQL = """, pairs AS (
  SELECT coalesce(o.cv_id, n.cv_id) AS cv_id, o AS o, n AS n FROM profiles o FULL JOIN page_profiles n ON o.cv_id = n.cv_id)"""


def J(name: str):
    return F.array_join(name, "|").alias(name)


@query("profile_records", "S12", PP + """
SELECT 'document' AS kind, cv_id, full_name, email, phone, title, organization, years, summary, city, country,
  array_to_string(primary_skills, '|') AS primary_skills, array_to_string(secondary_skills, '|') AS secondary_skills,
  array_to_string(certs, '|') AS certs, len(projects) AS projects,
  array_to_string(list_transform(projects, lambda x: x.name || ':' || len(x.technologies) || ':' || len(x.responsibilities)), '|') AS project_keys,
  array_to_string(list_transform(work, lambda x: x.organization || ':' || x.designation || ':' || x.start_date || ':' || x.end_date), '|') AS work_keys,
  array_to_string(list_transform(education, lambda x: x.degree || ':' || x.institution || ':' || x.year), '|') AS education_keys
FROM (SELECT * FROM profiles UNION ALL SELECT * FROM page_profiles)""".replace("'document' AS kind, ", ""))
def profile_records(spark, sf):
    both = p.profiles(spark, sf).unionByName(p.page_profiles(spark, sf))
    return both.select(
        "cv_id", "full_name", "email", "phone", "title", "organization", "years", "summary", "city", "country",
        J("primary_skills"), J("secondary_skills"), J("certs"), F.size("projects").cast("long").alias("projects"),
        F.expr("array_join(transform(projects, x -> concat_ws(':', x.name, size(x.technologies), size(x.responsibilities))), '|')").alias("project_keys"),
        F.expr("array_join(transform(work, x -> concat_ws(':', x.organization, x.designation, x.start_date, x.end_date)), '|')").alias("work_keys"),
        F.expr("array_join(transform(education, x -> concat_ws(':', x.degree, x.institution, x.year)), '|')").alias("education_keys"),
    )


UNION_CI = """(SELECT coalesce(string_agg(u, '|' ORDER BY i), '') FROM (
    SELECT u, i FROM (SELECT trim(unnest(l)) AS u, generate_subscripts(l, 1) AS i FROM (SELECT list_concat(coalesce({a}, []), coalesce({b}, [])) AS l))
    WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY lower(u) ORDER BY i) = 1))"""


def _longer(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, '') <> '' AND (coalesce({a}, '') = '' OR length({b}) > length({a})) THEN {b} ELSE {a} END"


@query("merge_canonical_records", "M5 M6 M7 U1 U2", PP + PAIRS_SQL + f"""
SELECT cv_id, {', '.join(f"{_longer('o.' + f, 'n.' + f)} AS {f}" for f in merge.TEXT_FIELDS)},
  CASE WHEN n.years <> 0 AND (coalesce(o.years, 0) = 0 OR length(n.years::VARCHAR) > length(o.years::VARCHAR)) THEN n.years ELSE o.years END AS years,
  coalesce({_longer('o.city', 'n.city')}, '') AS city, coalesce({_longer('o.country', 'n.country')}, '') AS country,
  {UNION_CI.format(a='o.primary_skills', b='n.primary_skills')} AS primary_skills,
  {UNION_CI.format(a='o.secondary_skills', b='n.secondary_skills')} AS secondary_skills,
  array_to_string(list_concat(coalesce(o.certs, []), list_filter(coalesce(n.certs, []), lambda x: NOT coalesce(list_contains(o.certs, x), false))), '|') AS certs
FROM pairs""")
def merge_canonical_records(spark, sf):
    merged = merge.merge_profiles(p.profiles(spark, sf), p.page_profiles(spark, sf), "document_upload")
    return merged.select(
        "cv_id", *merge.TEXT_FIELDS, "years", "location.city", "location.country",
        J("primary_skills"), J("secondary_skills"), J("certs"),
    )


@query("merge_source_update", "M22", PP + PAIRS_SQL + f""",
t AS (SELECT cv_id, CASE WHEN o.cv_id IS NULL THEN 1 ELSE o.cv_id % 5 + 2 END AS version, {', '.join(f"coalesce({_longer('o.' + f, 'n.' + f)}, '') AS {f}" for f in ('full_name', 'phone', 'email', 'city', 'country'))} FROM pairs)
SELECT cv_id, version, TIMESTAMP '2024-02-02 00:00:00' AS expires_at, 'active' AS status, full_name <> '' AND phone <> '' AND email <> '' AND city <> '' AND country <> '' AS can_export FROM t""")
def merge_source_update(spark, sf):
    state = p.profiles(spark, sf).withColumn("version", F.col("cv_id") % 5 + 1)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = merge.update_from_source(state, p.page_profiles(spark, sf), "document_upload", now=now)
    return out.select("cv_id", "version", "expires_at", "status", "can_export")


PROJECT_MATCH_SQL = """(trim(lower(e.name)) <> '' AND trim(lower(f.name)) <> '' AND (trim(lower(e.name)) = trim(lower(f.name))
    OR len(list_intersect(string_split(e.name, ' '), string_split(f.name, ' ')))
       / len(list_distinct(list_concat(string_split(e.name, ' '), string_split(f.name, ' ')))) > 0.6))"""


WALK_SQL = PP + PAIRS_SQL + f""",
both_sides AS MATERIALIZED (SELECT cv_id, o.projects AS op, n.projects AS np FROM pairs WHERE len(o.projects) > 0 AND len(n.projects) > 0),
hits AS MATERIALIZED (
  SELECT cv_id, i, list(j ORDER BY j) AS js FROM (
    SELECT cv_id, i, unnest(generate_series(1, len(np))) AS j, e, np FROM (
      SELECT cv_id, np, unnest(op) AS e, generate_subscripts(op, 1) AS i FROM both_sides)) x, LATERAL (SELECT x.np[x.j] AS f) y
  WHERE {PROJECT_MATCH_SQL} GROUP BY ALL),
walk AS (
  SELECT cv_id, 0 AS i, len(op) AS n, CAST([] AS BIGINT[]) AS used FROM both_sides
  UNION ALL
  SELECT w.cv_id, w.i + 1, w.n, list_append(w.used, coalesce(list_filter(h.js, lambda j: NOT list_contains(w.used, j))[1], 0))
  FROM walk w LEFT JOIN hits h ON h.cv_id = w.cv_id AND h.i = w.i + 1 WHERE w.i < w.n)"""


@query("merge_match_projects", "J13 T10", WALK_SQL + " SELECT cv_id, array_to_string(list_transform(used, lambda u: u - 1), '|') AS partners FROM walk WHERE i = n")
def merge_match_projects(spark, sf):
    both = p.profiles(spark, sf).select("cv_id", F.col("projects").alias("op")).join(
        p.page_profiles(spark, sf).select("cv_id", F.col("projects").alias("np")), "cv_id"
    ).where("size(op) > 0 AND size(np) > 0")
    return both.select("cv_id", F.array_join(merge.match_projects(F.col("op"), F.col("np")), "|").alias("partners"))


@query("merge_match_work", "J14", PP + PAIRS_SQL + """,
ow AS (SELECT cv_id, i, lower(trim(w.organization)) AS a, lower(trim(w.designation)) AS b FROM (
  SELECT cv_id, unnest(o.work) AS w, generate_subscripts(o.work, 1) AS i FROM pairs WHERE o.cv_id IS NOT NULL AND n.cv_id IS NOT NULL)),
nw AS (SELECT cv_id, i, lower(trim(w.organization)) AS a, lower(trim(w.designation)) AS b FROM (
  SELECT cv_id, unnest(n.work) AS w, generate_subscripts(n.work, 1) AS i FROM pairs WHERE o.cv_id IS NOT NULL AND n.cv_id IS NOT NULL)),
ok AS (SELECT *, row_number() OVER (PARTITION BY cv_id, a, b ORDER BY i) AS r FROM ow),
nk AS (SELECT *, row_number() OVER (PARTITION BY cv_id, a, b ORDER BY i) AS r FROM nw)
SELECT ok.cv_id, string_agg(coalesce(nk.i - 1, -1)::VARCHAR, '|' ORDER BY ok.i) AS partners
FROM ok LEFT JOIN nk ON nk.cv_id = ok.cv_id AND nk.a = ok.a AND nk.b = ok.b AND nk.r = ok.r AND ok.a <> '' AND ok.b <> ''
GROUP BY 1""")
def merge_match_work(spark, sf):
    both = p.profiles(spark, sf).select("cv_id", F.col("work").alias("ow")).join(
        p.page_profiles(spark, sf).select("cv_id", F.col("work").alias("nw")), "cv_id"
    ).where("size(ow) > 0")
    partners = merge.match_exact(F.col("ow"), F.col("nw"), "organization", "designation")
    return both.select("cv_id", F.array_join(partners, "|").alias("partners"))


TECHS = "array_to_string({}, '|')"
MERGED_SQL = WALK_SQL + f""",
done AS MATERIALIZED (SELECT w.cv_id, used, op, np FROM walk w JOIN both_sides b ON b.cv_id = w.cv_id WHERE i = n),
ex AS (SELECT cv_id, unnest(op) AS e, unnest(used) AS u, np FROM done),
mg AS (SELECT cv_id, e, np[u] AS f, u FROM ex),
lists AS (
  SELECT cv_id, CASE WHEN u > 0 AND f.name <> '' AND (e.name = '' OR length(f.name) >= length(e.name)) THEN f.name ELSE e.name END AS name,
    CASE WHEN u > 0 AND f.client <> '' AND (e.client = '' OR length(f.client) >= length(e.client)) THEN f.client ELSE e.client END AS client,
    CASE WHEN u > 0 AND f.description <> '' AND (e.description = '' OR len(regexp_split_to_array(trim(f.description), '\\s+')) > len(regexp_split_to_array(trim(e.description), '\\s+')) * 1.2
      OR length(f.description) > length(e.description) * 1.5) THEN f.description ELSE e.description END AS description,
    CASE WHEN u > 0 THEN {UNION_CI.format(a='e.technologies', b='f.technologies')} ELSE {TECHS.format('e.technologies')} END AS technologies,
    CASE WHEN u > 0 AND len(f.responsibilities) > len(e.responsibilities) THEN len(f.responsibilities) ELSE len(e.responsibilities) END AS responsibilities FROM mg
  UNION ALL SELECT cv_id, x.name, x.client, x.description, {TECHS.format('x.technologies')}, len(x.responsibilities) FROM (
    SELECT cv_id, used, unnest(np) AS x, generate_subscripts(np, 1) AS j FROM done) WHERE NOT list_contains(used, j)
  UNION ALL SELECT cv_id, x.name, x.client, x.description, {TECHS.format('x.technologies')}, len(x.responsibilities) FROM (
    SELECT cv_id, unnest(list_concat(coalesce(o.projects, []), coalesce(n.projects, []))) AS x FROM pairs WHERE cv_id NOT IN (SELECT cv_id FROM done)))
SELECT * FROM lists"""


@query("merge_project_lists", "M8 M9 M5", MERGED_SQL)
def merge_project_lists(spark, sf):
    merged = merge.merge_profiles(p.profiles(spark, sf), p.page_profiles(spark, sf), "document_upload")
    return A.explode_items(merged, ["cv_id"], F.col("projects"), "x").select(
        "cv_id", "x.name", "x.client", "x.description", F.array_join("x.technologies", "|").alias("technologies"),
        F.size("x.responsibilities").alias("responsibilities"),
    )


@query("merge_richer_summary", "M8", PP + PAIRS_SQL + """
SELECT cv_id, CASE WHEN coalesce(o.summary, '') = '' THEN coalesce(n.summary, '') <> '' WHEN coalesce(n.summary, '') = '' THEN false
  ELSE len(regexp_split_to_array(trim(n.summary), '\\s+')) > len(regexp_split_to_array(trim(o.summary), '\\s+')) * 1.2
    OR length(n.summary) > length(o.summary) * 1.5 END AS take_new,
  coalesce(len(n.projects), 0) > coalesce(len(o.projects), 0) AS take_new_list FROM pairs""")
def merge_richer_summary(spark, sf):
    o, n = p.profiles(spark, sf).alias("o"), p.page_profiles(spark, sf).alias("n")
    joined = o.join(n, F.col("o.cv_id") == F.col("n.cv_id"), "full_outer")
    return joined.select(
        F.coalesce("o.cv_id", "n.cv_id").alias("cv_id"),
        V.richer_text(F.col("n.summary"), F.col("o.summary")).alias("take_new"),
        V.richer_list(F.col("n.projects"), F.col("o.projects")).alias("take_new_list"),
    )


@query("merge_strategies", "M13 M14 M17 M19", PP + PAIRS_SQL + """
SELECT cv_id, coalesce(nullif(o.title, ''), nullif(n.title, '')) AS questionnaire_wins,
  coalesce(nullif(n.title, ''), nullif(o.title, '')) AS extracted_wins,
  coalesce(nullif(o.organization, ''), n.organization) AS fill_gap,
  coalesce(nullif(n.summary, ''), nullif(o.summary, '')) AS prefer_new,
  array_to_string(list_concat(coalesce(o.certs, []), list_filter(coalesce(n.certs, []), lambda x: NOT coalesce(list_contains(o.certs, x), false))), '|') AS merged_list,
  array_to_string(CASE WHEN len(coalesce(n.certs, [])) > 0 THEN n.certs ELSE coalesce(o.certs, []) END, '|') AS extracted_list
FROM pairs""")
def merge_strategies(spark, sf):
    o, n = p.profiles(spark, sf).alias("o"), p.page_profiles(spark, sf).alias("n")
    joined = o.join(n, F.col("o.cv_id") == F.col("n.cv_id"), "full_outer")
    old, new = F.coalesce("o.certs", A.empty("string")), F.coalesce("n.certs", A.empty("string"))
    return joined.select(
        F.coalesce("o.cv_id", "n.cv_id").alias("cv_id"),
        V.merge_by_strategy(F.col("o.title"), F.col("n.title"), "questionnaire_wins").alias("questionnaire_wins"),
        V.merge_by_strategy(F.col("o.title"), F.col("n.title"), "extracted_wins").alias("extracted_wins"),
        V.fill_gap(F.col("o.organization"), F.col("n.organization")).alias("fill_gap"),
        V.merge_preferring(F.col("o.summary"), F.col("n.summary"), True).alias("prefer_new"),
        F.array_join(V.merge_lists_by_strategy(old, new, "merge"), "|").alias("merged_list"),
        F.array_join(V.merge_lists_by_strategy(old, new, "extracted_wins"), "|").alias("extracted_list"),
    )


@query("merge_responsibilities_unlike", "U3 X17", P + """,
r AS (SELECT cv_id, projects[1].responsibilities AS old, projects[2].responsibilities AS new FROM profiles WHERE len(projects) >= 2),
n AS (SELECT cv_id, old, unnest(new) AS x, generate_subscripts(new, 1) AS i FROM r),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda t: t <> '')) AS xw FROM n),
k AS (SELECT cv_id, i, x FROM w WHERE len(list_filter(old, lambda y:
  len(list_intersect(xw, list_filter(regexp_split_to_array(lower(y), '\\s+'), lambda t: t <> '')))
  / len(list_distinct(list_concat(xw, list_filter(regexp_split_to_array(lower(y), '\\s+'), lambda t: t <> '')))) > 0.7)) = 0)
SELECT r.cv_id, array_to_string(list_concat(old, coalesce((SELECT list(x ORDER BY i) FROM k WHERE k.cv_id = r.cv_id), [])), '|') AS merged FROM r""")
def merge_responsibilities_unlike(spark, sf):
    df = p.profiles(spark, sf).where("size(projects) >= 2").selectExpr(
        "cv_id", "projects[0].responsibilities AS old", "projects[1].responsibilities AS new"
    )
    return df.select("cv_id", F.array_join(A.union_unlike(F.col("old"), F.col("new")), "|").alias("merged"))


@query("merge_repeated_skills", "U7", P + """
SELECT cv_id, coalesce((SELECT string_agg(u, '|' ORDER BY i) FROM (
  SELECT u, list_sort(list(i))[2] AS i FROM (SELECT lower(unnest(secondary_skills)) AS u, generate_subscripts(secondary_skills, 1) AS i)
  GROUP BY u HAVING count(*) > 1)), '') AS repeated FROM profiles""")
def merge_repeated_skills(spark, sf):
    return p.profiles(spark, sf).select("cv_id", F.array_join(A.repeated(F.col("secondary_skills")), "|").alias("repeated"))


@query("merge_skill_sets", "U5 J19", P + """
, s AS (SELECT cv_id, primary_skills AS listed, list_transform(flatten(list_transform(projects, lambda x: x.technologies)), lambda t: lower(t)) AS shown FROM profiles)
SELECT cv_id, len(list_filter(listed, lambda x: list_contains(shown, x))) AS demonstrated,
  len(list_filter(listed, lambda x: NOT list_contains(shown, x))) AS only_listed,
  array_to_string(list_filter(listed[1:3], lambda x: NOT list_contains(shown, x)), '|') AS top_without_project FROM s""".replace("\n, s", ", s", 1))
def merge_skill_sets(spark, sf):
    shown = F.expr("array_distinct(transform(flatten(transform(projects, x -> x.technologies)), t -> lower(t)))")
    df = p.profiles(spark, sf).select("cv_id", F.col("primary_skills").alias("listed"), shown.alias("shown"))
    return df.select(
        "cv_id",
        F.size(F.array_intersect("listed", "shown")).cast("long").alias("demonstrated"),
        F.size(F.array_except("listed", "shown")).cast("long").alias("only_listed"),
        F.array_join(F.array_except(F.slice("listed", 1, 3), F.col("shown")), "|").alias("top_without_project"),
    )


CAND_SQL = PP + """,
cand AS (
  SELECT cv_id, field_path, value, 0.8 - (cv_id % 4) * 0.1 AS confidence, TIMESTAMP '2024-01-01' + to_minutes(cv_id) AS captured_at, 'pdf' AS source, 0 AS position
  FROM (UNPIVOT (SELECT cv_id, full_name, email, title, organization FROM profiles) ON full_name, email, title, organization INTO NAME field_path VALUE value)
  UNION ALL
  SELECT cv_id, field_path, value, 0.6 + (cv_id % 3) * 0.1, TIMESTAMP '2024-01-02' + to_minutes(cv_id % 50), 'voice', 1
  FROM (UNPIVOT (SELECT cv_id, full_name, email, title, organization FROM page_profiles) ON full_name, email, title, organization INTO NAME field_path VALUE value)
  UNION ALL
  SELECT c_custkey, field_path, value, NULL, TIMESTAMP '2023-12-01', 'manual', 2
  FROM (UNPIVOT (SELECT c_custkey, c_name AS full_name, lower(c_name) || '@example.com' AS email, c_mktsegment AS title, '' AS organization FROM customer)
    ON full_name, email, title, organization INTO NAME field_path VALUE value)),
cands AS (SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM cand WHERE value <> '')"""


def _candidates(spark, sf):
    docs = p.profiles(spark, sf).selectExpr(
        "*", "CAST(0.8 - (cv_id % 4) * 0.1 AS DOUBLE) AS confidence",
        "timestampadd(MINUTE, cv_id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS captured_at",
    )
    pages = p.page_profiles(spark, sf).selectExpr(
        "*", "CAST(0.6 + (cv_id % 3) * 0.1 AS DOUBLE) AS confidence",
        "timestampadd(MINUTE, cv_id % 50, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS captured_at",
    )
    manual = v.load(spark, sf, "customer").selectExpr(
        "c_custkey AS cv_id", "c_name AS full_name", "concat(lower(c_name), '@example.com') AS email", "c_mktsegment AS title",
        "'' AS organization", "CAST(NULL AS DOUBLE) AS confidence", "TIMESTAMP_NTZ'2023-12-01 00:00:00' AS captured_at",
    )
    return merge.field_candidates(
        {"pdf": docs, "voice": pages, "manual": manual}, ["full_name", "email", "title", "organization"]
    )


def _arbitrated(strategy: str, measure: str):
    sql = CAND_SQL + f"""
SELECT cv_id, field_path, value, source, coalesce(confidence, 0.5::DOUBLE) AS confidence FROM cands
QUALIFY row_number() OVER (PARTITION BY cv_id, field_path ORDER BY {measure} DESC, position) = 1"""

    @query(f"merge_arbitrate_{strategy}", "M11 J15", sql)
    def run(spark, sf):
        won = merge.arbitrate(_candidates(spark, sf), strategy)
        return won.select("cv_id", "field_path", "value", "source", "confidence")

    return run


_arbitrated("highest_confidence", "coalesce(confidence, 0.5::DOUBLE)")
_arbitrated("most_complete", "len(regexp_split_to_array(trim(value), '\\s+'))")
_arbitrated("newest", "captured_at")
_arbitrated("manual_priority", "CASE source WHEN 'manual' THEN 4 WHEN 'voice' THEN 3 WHEN 'docx' THEN 2 WHEN 'pdf' THEN 1 ELSE 0 END")


@query("merge_conflicts", "M12", CAND_SQL + """
, won AS (SELECT cv_id, field_path, value AS sv, source AS ss, coalesce(confidence, 0.5::DOUBLE) AS sc, position AS sp FROM cands
  QUALIFY row_number() OVER (PARTITION BY cv_id, field_path ORDER BY coalesce(confidence, 0.5::DOUBLE) DESC, position) = 1)
SELECT c.cv_id, c.field_path, sv AS selected, ss AS selected_source,
  bool_or(coalesce(confidence, 0.5::DOUBLE) > sc - 0.1::DOUBLE) AS close_confidence, bool_or(lower(value) <> lower(sv)) AS other_text
FROM cands c JOIN won w ON w.cv_id = c.cv_id AND w.field_path = c.field_path WHERE position <> sp
GROUP BY ALL HAVING close_confidence OR other_text""".replace("\n, won", ", won", 1))
def merge_conflicts(spark, sf):
    cands = _candidates(spark, sf)
    return merge.conflict_report(cands, merge.arbitrate(cands))


@query("merge_consensus", "A15", CAND_SQL + """
, votes AS (SELECT cv_id, field_path, value, count(*) AS n, sum(coalesce(confidence, 0.5::DOUBLE)) AS c, min(position) AS f FROM cands GROUP BY ALL)
SELECT cv_id, field_path, arg_max(value, n * 100 - f) AS value, round(max(n) / sum(n), 6)::DOUBLE AS consensus,
  round(CASE WHEN max(n) / sum(n) > 0.5 THEN least(1.0::DOUBLE, sum(c) / sum(n) * (1 + 0.2::DOUBLE * max(n) / sum(n))) ELSE sum(c) / sum(n) END, 6) AS confidence,
  reason IS NOT NULL AS needs_verification, reason AS verification_reason
FROM (SELECT *, CASE WHEN sure < 0.7 THEN 'confidence' WHEN share < 0.5 THEN 'consensus' WHEN total < 2 THEN 'results' END AS reason FROM (
  SELECT *, max(n) OVER w / sum(n) OVER w AS share, sum(n) OVER w AS total,
    CASE WHEN max(n) OVER w / sum(n) OVER w > 0.5 THEN least(1.0::DOUBLE, sum(c) OVER w / sum(n) OVER w * (1 + 0.2::DOUBLE * max(n) OVER w / sum(n) OVER w)) ELSE sum(c) OVER w / sum(n) OVER w END AS sure
  FROM votes WINDOW w AS (PARTITION BY cv_id, field_path))) GROUP BY ALL""".replace("\n, votes", ", votes", 1))
def merge_consensus(spark, sf):
    cands = _candidates(spark, sf).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    return merge.consensus_vote(cands)


FLOW = "CASE cv_id % 4 WHEN 0 THEN 'conversation' WHEN 1 THEN 'document_upload' WHEN 2 THEN 'audio_record' ELSE 'audio_upload' END"


@query("merge_flow_stages", "W14 T7", P + f""",
st AS (SELECT cv_id // 4 AS session_id, {FLOW} AS flow, cv_id % 12 = 5 AS is_active, length(text) AS written_at, full_name, organization, summary, email FROM profiles),
b AS (SELECT session_id, flow AS base_flow FROM st QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY is_active DESC, written_at DESC, flow DESC) = 1),
r AS (SELECT st.*, base_flow, CASE WHEN flow = base_flow THEN 0 WHEN flow = 'conversation' THEN 1 WHEN flow = 'document_upload' THEN 2
  WHEN flow = 'audio_record' THEN 3 ELSE 4 END AS k FROM st JOIN b USING (session_id))
SELECT session_id, any_value(base_flow) AS base_flow, arg_min(full_name, k) FILTER (full_name <> '') AS full_name,
  arg_min(organization, k) FILTER (organization <> '') AS organization, arg_min(summary, k) FILTER (summary <> '') AS summary,
  arg_min(email, k) FILTER (email <> '') AS email FROM r GROUP BY 1""")
def merge_flow_stages(spark, sf):
    stages = p.profiles(spark, sf).selectExpr(
        "cv_id div 4 AS session_id", f"{FLOW} AS flow", "cv_id % 12 = 5 AS is_active", "length(text) AS written_at",
        "full_name", "organization", "summary", "email",
    )
    return merge.resolve_flow_stages(stages, ["full_name", "organization", "summary", "email"])


# --- duplicates


@query("dedup_first_wins_rows", "W5", """
SELECT doc_id, source, count(*) OVER (PARTITION BY lower(trim(text))) AS copies FROM documents WHERE trim(text) <> ''
QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1""")
def dedup_first_wins_rows(spark, sf):
    docs = v.load(spark, sf, "documents").select("doc_id", "source", "text")
    return merge.first_wins_rows(docs, ["text"], "doc_id").select("doc_id", "source", "copies")


@query("dedup_first_wins_lists", "W5", P + """
, e AS (SELECT cv_id, unnest(work) AS w, generate_subscripts(work, 1) AS i FROM profiles),
k AS (SELECT cv_id, i, w, lower(trim(w.organization)) || chr(1) || lower(trim(w.designation)) || chr(1) || lower(trim(w.start_date)) AS key FROM e),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cv_id, key ORDER BY i) = 1)
SELECT cv_id, string_agg(w.organization || ':' || w.designation || ':' || w.start_date, '|' ORDER BY i) AS kept FROM d GROUP BY 1""".replace("\n, e", ", e", 1))
def dedup_first_wins_lists(spark, sf):
    df = p.profiles(spark, sf).where("size(work) > 0").select(
        "cv_id", merge.first_wins(F.col("work"), ["organization", "designation", "start_date"]).alias("kept")
    )
    return df.select("cv_id", F.expr("array_join(transform(kept, x -> concat_ws(':', x.organization, x.designation, x.start_date)), '|')").alias("kept"))


def _merged_entries_sql(source: str, name: str, keys: list[str], text: bool) -> str:
    norm = ", ".join(f"lower(trim(w.{k}))" for k in keys)
    part = f"PARTITION BY cv_id, {norm}"
    return P + f""",
e AS (SELECT cv_id, unnest({source}) AS w, generate_subscripts({source}, 1) - 1 AS i FROM profiles),
f AS (SELECT cv_id, i, w, row_number() OVER ({part} ORDER BY i) AS r, min(i) OVER ({part}) AS g FROM e WHERE trim(w.{keys[0]}) <> ''),
t AS (SELECT cv_id, g, string_agg(u, '|' ORDER BY i, j) AS technologies FROM (
  SELECT cv_id, g, i, u, j FROM (SELECT cv_id, g, i, unnest(w.technologies) AS u, generate_subscripts(w.technologies, 1) AS j FROM f)
  QUALIFY row_number() OVER (PARTITION BY cv_id, g, u ORDER BY i, j) = 1) GROUP BY ALL),
m AS (SELECT cv_id, g AS ordinal, {', '.join(f'arg_min(w.{k}, i) AS {k}' for k in keys)},
  arg_max(len(w.responsibilities), len(w.responsibilities)) AS responsibilities,
  arg_max(w.description, length(w.description) * 100000 - i) AS description FROM f GROUP BY ALL)
SELECT m.cv_id, m.ordinal, {', '.join(keys)}, responsibilities, description, coalesce(technologies, '') AS technologies
FROM m LEFT JOIN t ON t.cv_id = m.cv_id AND t.g = m.ordinal"""


@query("dedup_merge_projects", "W6", _merged_entries_sql("projects", "p", ["name", "client"], True))
def dedup_merge_projects(spark, sf):
    items = p.profiles(spark, sf).select("cv_id", F.posexplode("projects").alias("ordinal", "x")).select("cv_id", "ordinal", "x.*")
    out = merge.merge_duplicate_entries(items, ["name", "client"])
    return out.withColumns({
        "ordinal": F.col("ordinal").cast("long"), "responsibilities": F.size("responsibilities").cast("long"),
        "technologies": F.array_join("technologies", "|"),
    })


@query("dedup_merge_experience", "W7", P + """,
e AS (SELECT cv_id, unnest(work) AS w, generate_subscripts(work, 1) - 1 AS i FROM profiles),
f AS (SELECT cv_id, i, w, row_number() OVER (q ORDER BY i) AS r, min(i) OVER (q) AS g FROM e WHERE trim(w.organization) <> ''
  WINDOW q AS (PARTITION BY cv_id, lower(trim(w.organization)), lower(trim(w.designation)), lower(trim(w.start_date))))
SELECT cv_id, g AS ordinal, arg_min(w.organization, i) AS organization, arg_min(w.designation, i) AS designation,
  arg_min(w.start_date, i) AS start_date, count(*) AS merged FROM f GROUP BY cv_id, g""")
def dedup_merge_experience(spark, sf):
    items = p.profiles(spark, sf).select("cv_id", F.posexplode("work").alias("ordinal", "x")).select(
        "cv_id", "ordinal", "x.*", F.array("x.description").alias("responsibilities"), F.array("ordinal").alias("technologies")
    )
    out = merge.merge_duplicate_entries(items, ["organization", "designation", "start_date"], text_field=None)
    return out.select(
        "cv_id", F.col("ordinal").cast("long").alias("ordinal"), "organization", "designation", "start_date",
        F.size("technologies").cast("long").alias("merged"),
    )


# --- unmapped attributes: nested payloads of orders, one per order

LEAVES_SQL = """WITH leaves AS (
  SELECT o_orderkey % 500 AS cv_id, 'bucket' || (o_orderkey % 3) AS source, o_orderdate AS seen_at, path, label, value, value_type FROM (
    SELECT *, 'legacy.Order.Status ' AS path, 'Status ' AS label, to_json(o_orderstatus)::VARCHAR AS value, 'string' AS value_type FROM orders
    UNION ALL SELECT *, 'legacy.Order.tags[0]', 'tags', to_json(o_orderpriority)::VARCHAR, 'string' FROM orders
    UNION ALL SELECT *, 'legacy.Order.tags[1]', 'tags', CASE WHEN o_orderkey % 2 = 0 THEN 'true' END, 'boolean' FROM orders
    UNION ALL SELECT *, 'legacy.n', 'n', CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 4)::VARCHAR END, 'integer' FROM orders)
  WHERE value IS NOT NULL)"""


def _payloads(spark, sf):
    return v.load_spread(spark, sf, "orders", "o_orderkey").selectExpr(
        "o_orderkey % 500 AS cv_id", "concat('bucket', o_orderkey % 3) AS src", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS seen_at",
        """concat('{"Order":{"Status ":"', o_orderstatus, '","tags":["', o_orderpriority, '",',
            CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '""' END, ']},"n":', o_custkey % 4, ',"blank":" "}') AS payload""",
    )


def _sightings(payloads):
    return unmapped.attribute_rows(payloads, "payload", source=F.col("src"))


@query("unmapped_leaves", "X1 X3 X4 X5 M27 P5", LEAVES_SQL + """
SELECT cv_id, source, label AS original_label, lower(trim(label)) AS normalized_label, 'legacy' AS source_section, path AS source_path,
  value, value_type, seen_at FROM leaves""")
def unmapped_leaves(spark, sf):
    return _sightings(_payloads(spark, sf))


@query("unmapped_upsert", "A8", LEAVES_SQL + """
SELECT cv_id, source, path AS source_path, value, any_value(label) AS original_label, any_value(lower(trim(label))) AS normalized_label,
  any_value(value_type) AS value_type, count(*) AS occurrence_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
FROM leaves GROUP BY cv_id, source, path, value""")
def unmapped_upsert(spark, sf):
    # half of the batch is folded into the state that the other half left behind; a payload is taken apart in its half only
    payloads = _payloads(spark, sf)
    early = F.col("seen_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    return unmapped.upsert_attributes(_sightings(payloads.where(~early)), unmapped.upsert_attributes(_sightings(payloads.where(early))))


@query("unmapped_frequency", "A7", LEAVES_SQL + """
SELECT lower(trim(label)) AS normalized_label, count(*) AS occurrences FROM leaves GROUP BY 1""")
def unmapped_frequency(spark, sf):
    return unmapped.unmapped_frequency(unmapped.upsert_attributes(_sightings(_payloads(spark, sf))))


@query("unmapped_unknown_keys", "U4", """
SELECT o_orderkey AS cv_id, CASE WHEN o_orderkey % 3 = 0 THEN 'priority' ELSE 'priority,status' END AS unknown FROM orders""")
def unmapped_unknown_keys(spark, sf):
    payload = F.expr(
        "map('total', CAST(o_totalprice AS STRING), 'priority', o_orderpriority, "
        "'status', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END)"
    )
    found = unmapped.unknown_keys(payload, ["total", "candidate"])
    return v.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cv_id"), F.array_join(F.array_sort(F.map_keys(found)), ",").alias("unknown")
    )


# --- evidence

FIELDS = {
    "candidate.fullName": "full_name", "candidate.email": "email", "candidate.designation": "title",
    "candidate.organization": "organization", "candidate.years": "years", "candidate.city": "city",
    "skills.primarySkills": "primary_skills", "certifications": "certs",
}
NORM = "CASE WHEN trim(lower({x}), ' ,.;:-') IN ('none', 'null', 'n/a', 'na', 'undefined', '[]', '{{}}') THEN '' ELSE lower(regexp_replace(trim({x}), '\\s+', ' ', 'g')) END"
TRACE_SQL = P + """,
vals AS (
  SELECT cv_id, 'candidate.fullName' AS field_path, full_name AS raw, lines FROM profiles
  UNION ALL SELECT cv_id, 'candidate.email', email, lines FROM profiles
  UNION ALL SELECT cv_id, 'candidate.designation', title, lines FROM profiles
  UNION ALL SELECT cv_id, 'candidate.organization', organization, lines FROM profiles
  UNION ALL SELECT cv_id, 'candidate.years', years::VARCHAR, lines FROM profiles
  UNION ALL SELECT cv_id, 'candidate.city', city, lines FROM profiles
  UNION ALL SELECT cv_id, 'skills.primarySkills', unnest(primary_skills), lines FROM profiles
  UNION ALL SELECT cv_id, 'certifications', unnest(certs), lines FROM profiles),
n AS (SELECT cv_id, field_path, """ + NORM.format(x="coalesce(raw, '')") + """ AS value, lines FROM vals),
ev AS (SELECT cv_id, field_path, value, length(value) <= 2 AS short,
  list_filter(list_transform(lines, lambda l: """ + NORM.format(x="l") + """), lambda l: l <> '' AND contains(l, value))[1] AS first FROM n WHERE value <> ''),
trace AS (SELECT cv_id, field_path, value, short OR first IS NOT NULL AS supported,
  CASE WHEN short THEN '' ELSE coalesce(first, '') END AS evidence FROM ev)"""


@query("quality_traceability", "J9 X6", TRACE_SQL + " SELECT * FROM trace")
def quality_traceability(spark, sf):
    return quality.traceability(p.profiles(spark, sf), FIELDS, "lines")


METRIC_SQL = TRACE_SQL + """,
c AS (SELECT p.cv_id, 7 + CASE WHEN years IS NULL THEN 0 ELSE 1 END AS want, count(t.cv_id) AS got, count(*) FILTER (supported) AS ok,
    any_value(email) <> '' AS pass FROM profiles p LEFT JOIN trace t ON t.cv_id = p.cv_id GROUP BY p.cv_id, years),
m AS (SELECT cv_id, want AS expected_fields, got AS extracted_fields, ok AS supported_fields,
  round_even(CASE WHEN got = 0 THEN 1.0::DOUBLE ELSE ok / got END, 4) AS precision, round_even(ok / want, 4) AS recall,
  round_even(CASE WHEN got = 0 THEN 1.0::DOUBLE ELSE ok / got END, 4) AS accuracy,
  round_even(CASE WHEN got = 0 THEN 0.0::DOUBLE ELSE (got - ok) / got END, 4) AS hallucination_rate, round_even(got / want, 4) AS completeness_score,
  CASE WHEN pass THEN 1.0 ELSE 0.0 END::DOUBLE AS validation_pass_rate FROM c)"""


@query("quality_metrics", "A9 A10", METRIC_SQL + " SELECT * FROM m")
def quality_metrics(spark, sf):
    return quality.quality_metrics(p.profiles(spark, sf), FIELDS, "lines", validation_pass=F.col("email") != "")


@query("quality_corpus", "A9", METRIC_SQL + """
SELECT count(*) AS records, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy,
  round(avg(hallucination_rate), 6) AS hallucination_rate, round(avg(completeness_score), 6) AS completeness_score,
  round(avg(validation_pass_rate), 6) AS validation_pass_rate FROM m""")
def quality_corpus(spark, sf):
    return quality.corpus_quality(quality_metrics(spark, sf))


@query("merge_snapshot_restore", "M15", "WITH " + p.PROFILES + """
SELECT cv_id, CASE WHEN trim(title) <> '' THEN title WHEN cv_id % 3 = 0 THEN 'first' ELSE coalesce(nullif(trim(organization), ''), title) END AS title,
  array_to_string(CASE WHEN len(primary_skills) > 0 THEN primary_skills WHEN len(secondary_skills) > 0 THEN secondary_skills ELSE primary_skills END, '|') AS primary_skills FROM profiles""")
def merge_snapshot_restore(spark, sf):
    none = F.array().cast("array<string>")
    records = p.profiles(spark, sf).withColumn("snapshots", F.array(
        F.struct(F.when(F.col("cv_id") % 3 == 0, "first").alias("title"), none.alias("primary_skills")),
        F.struct(F.trim("organization").alias("title"), F.col("secondary_skills").alias("primary_skills"))))
    out = merge.restore_from_snapshots(records, ["title", "primary_skills"])
    return out.select("cv_id", "title", F.array_join("primary_skills", "|").alias("primary_skills"))
