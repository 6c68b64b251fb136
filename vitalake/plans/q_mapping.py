"""Registered queries: questionnaire joins, follow-ups, schema mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.functions import rules as R
from vitalake.operators import mapping as m, merge, questionnaire as qn, tracing, unmapped, validate as val
from vitalake.plans import profiles as p, texts as tx, views as v
from vitalake.plans.registry import query
from vitalake.sources import dims

P = "WITH " + p.PROFILES
ROLE_CASE = "CASE lower(trim(title)) " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in dims.TITLE_ROLES.items()) + " ELSE 'common' END"


@query("questions_role_of_title", "J4 S10", P + f" SELECT cv_id, title, {ROLE_CASE} AS role FROM profiles")
def questions_role_of_title(spark, sf):
    return qn.resolve_role(p.profiles(spark, sf).select("cv_id", "title"), dims.title_roles(spark))


# the question bank is every assistant turn; turns are dealt to banks by conversation
BANK_CASE = "CASE conv_id % 5 WHEN 0 THEN 'common' WHEN 1 THEN 'leadership' WHEN 2 THEN 'technical_manager' WHEN 3 THEN 'solution_architect' ELSE 'tech_lead' END"
BANK_SQL = f"""bank AS (SELECT {BANK_CASE} AS bank, conv_id * 1000000 + turn AS id, text AS question, CASE WHEN turn % 4 <> 1 THEN length(text) % 50 END AS ord
  FROM conversations WHERE role = 'assistant')"""


def _bank(spark, sf):
    return v.load(spark, sf, "conversations").where("role = 'assistant'").selectExpr(
        f"{BANK_CASE} AS bank", "conv_id * 1000000 + turn AS id", "text AS question", "CASE WHEN turn % 4 <> 1 THEN length(text) % 50 END AS `order`"
    )


ROLE_Q_SQL = BANK_SQL + """, roles AS (SELECT unnest(['technical_manager', 'solution_architect', 'tech_lead']) AS role),
w AS (SELECT role, 0 AS part, 'common' AS bank FROM roles UNION ALL SELECT role, 1, 'leadership' FROM roles WHERE role <> 'tech_lead' UNION ALL SELECT role, 2, role FROM roles),
f AS (SELECT role, part, id, question, coalesce(ord, 9999) AS ord FROM w JOIN bank USING (bank) WHERE trim(question) <> ''
  QUALIFY row_number() OVER (PARTITION BY role, lower(trim(question)) ORDER BY part, id) = 1),
role_questions AS (SELECT role, id, question, row_number() OVER (PARTITION BY role ORDER BY ord, part, id) AS position FROM f)"""


@query("questions_for_roles", "J5", "WITH " + ROLE_Q_SQL + " SELECT role, id, question, position FROM role_questions")
def questions_for_roles(spark, sf):
    roles = _bank(spark, sf).where("bank NOT IN ('common', 'leadership')").select(F.col("bank").alias("role")).distinct()
    out = qn.questions_for_roles(_bank(spark, sf), roles)
    return out.select("role", "id", "question", F.col("position").cast("long").alias("position"))


@query("questions_localized", "J6", "WITH " + BANK_SQL + """, q AS (SELECT id, question, CASE id % 4 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'DE' WHEN 2 THEN 'en_US' ELSE 'xx' END AS raw FROM bank),
r AS (SELECT id, question, CASE WHEN id % 4 < 2 THEN 'de' ELSE 'en' END AS locale FROM q),
t AS (SELECT 'de' AS locale, id, CASE WHEN id % 3 = 0 THEN ' ' ELSE 'de: ' || question END AS text FROM bank WHERE id % 5 <> 0)
SELECT r.id, r.locale, trim(coalesce(nullif(trim(t.text), ''), r.question)) AS question FROM r LEFT JOIN t ON t.locale = r.locale AND t.id = r.id""")
def questions_localized(spark, sf):
    questions = _bank(spark, sf).selectExpr("id", "question", "CASE id % 4 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'DE' WHEN 2 THEN 'en_US' ELSE 'xx' END AS locale")
    translations = _bank(spark, sf).where("id % 5 <> 0").selectExpr(
        "'de' AS locale", "id AS question_id", "CASE WHEN id % 3 = 0 THEN ' ' ELSE concat('de: ', question) END AS text"
    )
    return qn.localized_questions(questions, translations, supported=["en", "de"]).select("id", "locale", "question")


@query("questions_unasked", "J7", "WITH " + v.ANSWERS + """,
a AS (SELECT DISTINCT session_id, lower(trim(question)) AS q FROM answers WHERE ordinal % 3 <> 0), c AS (SELECT session_id, ordinal, question FROM answers)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.session_id = c.session_id AND a.q = lower(trim(c.question)))""")
def questions_unasked(spark, sf):
    answers = v.answers(spark, sf)
    asked = answers.where("ordinal % 3 <> 0").select("session_id", F.concat(F.lit("  "), F.lower("question"), F.lit(" ")).alias("question"))
    return qn.unasked_questions(answers.select("session_id", "ordinal", "question"), asked)


@query("questions_answer_pairs", "W20", "WITH " + v.ANSWERS + " SELECT * FROM answers")
def questions_answer_pairs(spark, sf):
    return v.answers(spark, sf)


MAP_SQL = "WITH " + v.ANSWERS + """,
mp AS (SELECT DISTINCT lower(trim(text)) AS q, CASE WHEN length(text) % 3 = 0 THEN 'skills' ELSE 'summary' END AS section, CASE WHEN length(text) % 3 = 0 THEN 'primary_skills' ELSE 'professional_summary' END AS field
  FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 0),
ma AS (SELECT session_id, ordinal, a.question, answer, section, field FROM answers a LEFT JOIN mp ON mp.q = lower(trim(a.question)))"""


def _mapping(spark, sf):
    return v.load(spark, sf, "conversations").where("role = 'assistant' AND length(text) % 2 = 0").selectExpr(
        "text AS question", "CASE WHEN length(text) % 3 = 0 THEN 'skills' ELSE 'summary' END AS section",
        "CASE WHEN length(text) % 3 = 0 THEN 'primary_skills' ELSE 'professional_summary' END AS field",
    )


@query("questions_mapped_answers", "J8", MAP_SQL + """
SELECT session_id, ordinal, section, field, CASE WHEN field = 'professional_summary' THEN 1 ELSE 0 END AS plain FROM ma WHERE field IS NOT NULL""")
def questions_mapped_answers(spark, sf):
    mapped, _ = qn.map_answers(v.answers(spark, sf), _mapping(spark, sf))
    stored = qn.answer_value(F.col("section"), F.col("field"), F.col("answer"))
    plain = F.when((F.size(stored) == 1) & (F.get(stored, F.lit(0)) == F.trim("answer")) & (F.col("field") == "professional_summary"), 1).otherwise(0)
    return mapped.select("session_id", "ordinal", "section", "field", plain.alias("plain"))


@query("questions_loss_guards", "M26 U4", MAP_SQL + """,
un AS (SELECT session_id, 'extraction' AS source, 'topic_' || ordinal % 3 AS label, question AS value FROM answers WHERE trim(question) <> ''),
attrs AS (SELECT session_id, 'questionnaire' AS source, question AS label, answer AS value FROM ma WHERE field IS NULL UNION ALL SELECT * FROM un)
SELECT 'attribute' AS kind, * FROM attrs UNION ALL SELECT 'warning', session_id, source, 'no canonical field for: ' || label, NULL FROM attrs
UNION ALL SELECT 'snapshot', session_id, 'questionnaire', question, answer FROM answers""")
def questions_loss_guards(spark, sf):
    answers = v.answers(spark, sf)
    mapped, _ = qn.map_answers(answers, _mapping(spark, sf))
    # what an extraction of each answer returned: one known key, and one by topic that no field takes
    extracted = F.map_from_arrays(F.array(F.lit("summary"), F.concat(F.lit("topic_"), (F.col("ordinal") % 3).cast("string"))), F.array("answer", "question"))
    unknown = answers.select("session_id", F.explode(unmapped.unknown_keys(extracted, ["summary"])).alias("key", "value"))
    rows = unmapped.loss_guard_rows(answers, mapped, unknown)
    return rows["attributes"].select(F.lit("attribute").alias("kind"), "session_id", "source", F.col("original_label").alias("label"), "value").unionByName(
        rows["warnings"].select(F.lit("warning").alias("kind"), "session_id", "source", F.col("warning").alias("label"), F.lit(None).cast("string").alias("value"))
    ).unionByName(
        rows["snapshots"].select(F.lit("snapshot").alias("kind"), "session_id", F.lit("questionnaire").alias("source"), F.col("question").alias("label"), F.col("answer").alias("value")))


@query("questions_low_confidence", "V15", "WITH " + v.EXTRACTIONS + """
SELECT extraction_id AS cv_id, field_path AS field, 'Found ' || chr(39) || source_type || chr(39) || ' for ' || field_path || '. Is that right?' AS question, 'high' AS priority
FROM field_conf JOIN extractions USING (extraction_id) WHERE confidence_score < 0.6""")
def questions_low_confidence(spark, sf):
    held = v.extractions(spark, sf).select(F.col("extraction_id").alias("cv_id"), F.col("source_type").alias("value"), F.explode("field_confidence").alias("field", "confidence"))
    return qn.low_confidence_questions(held).select("cv_id", "field", "question", "priority")


@query("questions_followup_text", "V14", "WITH " + v.ANSWERS + f""",
f AS (SELECT *, 'skills ' || lower(trim(question)) AS q, len(regexp_split_to_array(trim(answer), '\\s+')) AS n FROM answers)
SELECT session_id, ordinal, CASE WHEN trim(answer) = '' THEN 'more_details' WHEN contains(q, 'professional profile') AND n < 8 THEN 'expand_summary' WHEN n < 8 THEN 'add_skills' END AS followup FROM f""")
def questions_followup_text(spark, sf):
    text = qn.followup_text(F.concat(F.lit("Skills "), "question"), F.col("answer"), F.lit("common"))
    return v.answers(spark, sf).select("session_id", "ordinal", text.alias("followup"))


FOLLOW_SQL = P + """, fu AS (
  SELECT cv_id, 'full_name' AS field, 'critical' AS priority, 0 AS position FROM profiles WHERE full_name = '' UNION ALL SELECT cv_id, 'email', 'critical', 1 FROM profiles WHERE email = ''
  UNION ALL SELECT cv_id, 'phone', 'high', 2 FROM profiles WHERE phone = '' UNION ALL SELECT cv_id, 'title', 'high', 3 FROM profiles WHERE title = ''
  UNION ALL SELECT cv_id, 'summary', 'high', 4 FROM profiles WHERE summary = '' UNION ALL SELECT cv_id, 'primary_skills', 'high', 5 FROM profiles WHERE len(primary_skills) = 0
  UNION ALL SELECT cv_id, 'work', 'high', 6 FROM profiles WHERE len(work) = 0 UNION ALL SELECT cv_id, 'projects', 'medium', 7 FROM profiles WHERE len(projects) = 0
  UNION ALL SELECT cv_id, 'education', 'medium', 8 FROM profiles WHERE len(education) = 0 UNION ALL SELECT cv_id, 'certs', 'low', 9 FROM profiles WHERE len(certs) = 0
  UNION ALL SELECT cv_id, 'primary_skills', 'high', 100 FROM profiles WHERE regexp_matches(lower(title), 'engineer|developer|architect') AND len(primary_skills) = 0
  UNION ALL SELECT cv_id, 'projects', 'medium', 101 FROM profiles WHERE regexp_matches(lower(title), 'engineer|developer|architect') AND len(projects) = 0
  UNION ALL SELECT cv_id, 'team_management', 'medium', 102 FROM profiles WHERE regexp_matches(lower(title), 'manager|lead|director')
  UNION ALL SELECT cv_id, 'education[' || (i - 1) || '].year', 'low', 201 FROM (SELECT cv_id, unnest(education) AS x, generate_subscripts(education, 1) AS i FROM profiles) WHERE x.year = ''
  UNION ALL SELECT cv_id, 'summary', 'medium', 300 FROM profiles WHERE length(summary) < 100 UNION ALL SELECT cv_id, 'primary_skills', 'medium', 301 FROM profiles WHERE len(primary_skills) < 3
  UNION ALL SELECT cv_id, 'certs', 'low', 302 FROM profiles WHERE len(certs) = 0),
one AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY cv_id, field ORDER BY position) = 1),
ranked AS (SELECT cv_id, field, priority, row_number() OVER (PARTITION BY cv_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, position, field) AS ask_order FROM one)"""


@query("questions_followups", "V15 W9 O5", FOLLOW_SQL + " SELECT * FROM ranked WHERE ask_order <= 5")
def questions_followups(spark, sf):
    out = qn.prioritise(qn.followup_candidates(p.profiles(spark, sf)), k=5)
    return out.select("cv_id", "field", "priority", F.col("ask_order").cast("long").alias("ask_order"))


@query("questions_from_issues", "J20 V15", P + """, i AS (
  SELECT cv_id, 'full_name' AS field, 'critical' AS level FROM profiles WHERE trim(full_name) = '' UNION ALL SELECT cv_id, 'email', 'critical' FROM profiles WHERE email = ''
  UNION ALL SELECT cv_id, 'phone', 'critical' FROM profiles WHERE phone = '' UNION ALL SELECT cv_id, 'primary_skills', 'error' FROM profiles WHERE len(primary_skills) = 0
  UNION ALL SELECT cv_id, 'education', 'warning' FROM profiles WHERE len(education) = 0)
SELECT cv_id, field, CASE field WHEN 'full_name' THEN 'Which name should the profile carry?' WHEN 'email' THEN 'Which e-mail address may be shown?' ELSE 'What should stand under ' || replace(field, '_', ' ') || '?' END AS question,
  CASE WHEN level = 'warning' THEN 'high' ELSE 'critical' END AS priority FROM i""")
def questions_from_issues(spark, sf):
    issues = R.issue_rows(val.rule_table_issues(p.profiles(spark, sf)).select("cv_id", "issues"))
    issues = issues.where(F.col("rule").isin("required_full_name", "required_email", "required_contact", "required_skills", "minimum_education")).withColumn(
        "field", F.when(F.col("field") == "skills", "primary_skills").otherwise(F.col("field"))
    )
    templates = spark.createDataFrame([(f, qn.FIELD_QUESTIONS[f][0]) for f in ("full_name", "email")], "field string, question string")
    return qn.issue_questions(issues, templates).select("cv_id", "field", "question", "priority")


STATE = "CASE turn % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'skipped' ELSE 'open' END"


@query("questions_next", "W10", f"""
SELECT 'conv_' || conv_id AS session_id, turn AS question_id, length(text) % 9 AS "order" FROM conversations WHERE {STATE} = 'open'
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 9, turn) = 1""")
def questions_next(spark, sf):
    turns = v.load(spark, sf, "conversations").selectExpr(
        "concat('conv_', conv_id) AS session_id", "turn AS question_id", "CAST(length(text) % 9 AS BIGINT) AS `order`", f"{STATE} AS state"
    )
    return qn.next_question(turns.drop("state"), turns.where("state <> 'open'"))


@query("questions_status", "A23", f"""
SELECT 'conv_' || conv_id AS session_id, count(*) AS total, count(*) FILTER ({STATE} = 'answered') AS answered, count(*) FILTER ({STATE} = 'skipped') AS skipped,
  count(*) FILTER ({STATE} = 'open') AS remaining FROM conversations GROUP BY 1""")
def questions_status(spark, sf):
    turns = v.load(spark, sf, "conversations").selectExpr("concat('conv_', conv_id) AS session_id", "turn AS question_id", f"{STATE} AS state")
    return qn.followup_status(turns)


@query("questions_collected", "A23", MAP_SQL + """
SELECT session_id, string_agg(field || '=' || md5(answer), '|' ORDER BY field) AS answers FROM (
  SELECT session_id, field, arg_max(answer, ordinal) AS answer FROM ma WHERE field IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def questions_collected(spark, sf):
    mapped, _ = qn.map_answers(v.answers(spark, sf), _mapping(spark, sf))
    out = qn.answers_collected(mapped)
    pairs = F.transform(F.map_entries("answers"), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return out.select("session_id", F.array_join(pairs, "|").alias("answers"))


@query("questions_education_answers", "X10", "WITH " + tx.TEXTS + r""",
f AS (SELECT doc_id, regexp_replace(trim(text), '\r?\n+', ' ', 'g') AS t FROM transcripts),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(?i)(Next,|Then|I have completed intermediate|My secondary school)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM f),
r AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS position FROM s)
SELECT doc_id, position, coalesce(nullif(trim(regexp_extract(x, '(?i)(Master(?: of [A-Za-z ]+)?|Bachelor(?: of [A-Za-z ]+)?|B\.?Sc\.?|B\.?Tech\.?|M\.?C\.?A\.?|MBA|Bachelors?|Masters?)', 1)), ''),
    nullif(trim(regexp_extract(x, '(?i)([0-9]+(?:th|st|nd|rd) standard|Master in [^.,]+)', 1)), ''), x) AS qualification,
  trim(regexp_extract(x, '(?i)university (?:name )?(?:is )?([^.,]+)', 1)) AS university, regexp_extract(x, '(20[0-9]{2}|19[0-9]{2})', 1) AS year,
  trim(regexp_extract(x, '(?i)([0-9]{1,3}(?:\.[0-9]+)?\s*(?:%|percent|percentage))', 1)) AS percentage FROM r""")
def questions_education_answers(spark, sf):
    rows = tx.transcripts(spark, sf).select("doc_id", F.posexplode_outer(qn.parse_education_answer(F.col("text"))).alias("position", "e"))
    return rows.select("doc_id", F.col("position").cast("long"), "e.qualification", "e.university", "e.year", "e.percentage")


# --- mapping


PAYLOAD = (
    "to_json(named_struct('full_name', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, 'name', concat('N', c_custkey), "
    "'contact', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END, 'mail', lower(c_mktsegment), 'id', c_custkey, "
    "'city', concat('City', c_nationkey, ', ST, Land'), 'experience', concat(c_custkey % 9, ' years 14 months'), 'born', ' 1990-01 ', "
    "'skills', CASE WHEN c_custkey % 2 = 0 THEN 'Java, SQL' ELSE '' END, 'tags', array(c_mktsegment, 'x'), 'obj', named_struct('a', 1)))"
)


@query("mapping_canonical", "M1 X2 T1", """
SELECT c_custkey AS cv_id, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey ELSE c_name END AS "candidate_fullName",
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS "candidate_phoneNumber", lower(c_mktsegment) AS candidate_email, c_custkey::VARCHAR AS "candidate_portalId" FROM customer""")
def mapping_canonical(spark, sf):
    df = v.load(spark, sf, "customer").selectExpr("c_custkey AS cv_id", f"{PAYLOAD} AS payload")
    return m.map_to_canonical(df).select("cv_id", "candidate_fullName", "candidate_phoneNumber", "candidate_email", "candidate_portalId")


@query("mapping_list_fields", "M2", """
SELECT c_custkey AS cv_id, c_mktsegment || '|x' AS tags, CASE WHEN c_custkey % 2 = 0 THEN 'Java, SQL' ELSE lower(c_mktsegment) END AS skills FROM customer""")
def mapping_list_fields(spark, sf):
    df = v.load(spark, sf, "customer").selectExpr("c_custkey AS cv_id", f"{PAYLOAD} AS payload")
    return df.select(
        "cv_id", F.array_join(m.map_list_field(df, ["obj", "tags"]), "|").alias("tags"), F.array_join(m.map_list_field(df, ["skills", "obj", "mail"]), "|").alias("skills")
    )


@query("mapping_channel_rules", "M3 P1 X14", """
SELECT c_custkey AS cv_id, 'City' || c_nationkey AS city, (c_custkey % 9 + 1)::VARCHAR AS years, '1990-01' AS born,
  CASE WHEN c_custkey % 2 = 0 THEN 'Java|SQL' END AS skills, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'skills' END AS missing_mandatory FROM customer""")
def mapping_channel_rules(spark, sf):
    df = v.load(spark, sf, "customer").selectExpr("c_custkey AS cv_id", f"{PAYLOAD} AS payload")
    rules = [("city", "city", "location_city", True), ("experience", "years", "experience_years", False), ("born", "born", "date", False), ("skills", "skills", "skills", True)]
    return m.apply_rules(df, rules).drop("payload").withColumn("missing_mandatory", F.array_join("missing_mandatory", "|"))


@query("mapping_reverse_lookup", "M4 J22", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'candidate.email' WHEN 'view' THEN 'candidate.phoneNumber' END AS canonical_path,
  CASE event_type WHEN 'signup' THEN 'audio_upload' WHEN 'error' THEN 'manual_edit' ELSE 'other' END AS source FROM events""")
def mapping_reverse_lookup(spark, sf):
    fields = v.load(spark, sf, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'click' THEN 'mail' WHEN 'view' THEN 'mobile' ELSE event_type END AS source_field",
        "CASE event_type WHEN 'signup' THEN ' Voice' WHEN 'error' THEN 'MANUAL' ELSE 'other' END AS raw",
    )
    return m.find_canonical_path(fields).select("event_id", "canonical_path", m.canonical_source(F.col("raw")).alias("source"))


FIELD_ROWS = """fl AS (SELECT cv_id, path, value FROM (UNPIVOT (SELECT cv_id, full_name, email, summary FROM profiles) ON full_name, email, summary INTO NAME path VALUE value)),
ed AS (SELECT actor_user_id AS cv_id, CASE WHEN k % 2 = 0 THEN 'email' ELSE 'note' END AS path, event_message || id AS new_value, created_at AS edited_at, id FROM audit_log)"""


def _fields(spark, sf):
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).alias("value")) for n in ("full_name", "email", "summary")])
    return p.profiles(spark, sf).select("cv_id", F.explode(pairs).alias("f")).select("cv_id", "f.*")


def _edits(spark, sf):
    return v.audit_log(spark, sf).selectExpr(
        "actor_user_id AS cv_id", "CASE WHEN k % 2 = 0 THEN 'email' ELSE 'note' END AS path", "concat(event_message, id) AS new_value",
        "created_at AS edited_at", "actor_username AS edited_by", "'edit' AS reason", "id",
    )


@query("mapping_edits_applied", "M16", "WITH " + p.PROFILES + ",\n" + v.AUDIT_LOG + ",\n" + FIELD_ROWS + """,
la AS (SELECT cv_id, path, arg_max(new_value, edited_at) AS new FROM ed GROUP BY ALL)
SELECT coalesce(fl.cv_id, la.cv_id) AS cv_id, coalesce(fl.path, la.path) AS path, coalesce(new, value) AS value FROM fl FULL JOIN la ON la.cv_id = fl.cv_id AND la.path = fl.path""")
def mapping_edits_applied(spark, sf):
    return m.apply_edits(_fields(spark, sf), _edits(spark, sf))[0]


@query("mapping_edit_log", "M16", "WITH " + p.PROFILES + ",\n" + v.AUDIT_LOG + ",\n" + FIELD_ROWS + """,
e AS (SELECT *, lag(new_value) OVER w AS before, row_number() OVER w AS n FROM ed WINDOW w AS (PARTITION BY cv_id, path ORDER BY edited_at, id))
SELECT e.cv_id, e.path, e.id, new_value, CASE WHEN n = 1 THEN fl.value ELSE before END AS previous_value FROM e LEFT JOIN fl ON fl.cv_id = e.cv_id AND fl.path = e.path""")
def mapping_edit_log(spark, sf):
    return m.apply_edits(_fields(spark, sf), _edits(spark, sf))[1].select("cv_id", "path", "id", "new_value", "previous_value")


@query("mapping_reviewer", "J21", "WITH " + v.AUDIT_LOG + """,
mp AS (SELECT actor_user_id AS cv_id, CASE k % 3 WHEN 0 THEN 'candidate.email' WHEN 1 THEN 'skills.primarySkills' ELSE 'other.thing' END AS target_path, error_message AS value FROM audit_log)
SELECT cv_id, count(*) FILTER (target_path <> 'other.thing' AND trim(coalesce(value, '')) <> '') AS applied,
  count(*) FILTER (target_path = 'other.thing' OR trim(coalesce(value, '')) = '') AS skipped FROM mp GROUP BY 1""")
def mapping_reviewer(spark, sf):
    return m.apply_reviewer_mappings(_fields(spark, sf), _mappings(spark, sf))[1]


@query("mapping_reviewer_fields", "J21", "WITH " + p.PROFILES + ",\n" + v.AUDIT_LOG + ",\n" + FIELD_ROWS + """,
mp AS (SELECT actor_user_id AS cv_id, id, CASE k % 3 WHEN 0 THEN 'candidate.email' WHEN 1 THEN 'skills.primarySkills' ELSE 'other.thing' END AS path, trim(error_message) AS value FROM audit_log)
SELECT cv_id, path, value FROM fl UNION ALL SELECT cv_id, path, arg_max(value, id) FROM mp WHERE path <> 'other.thing' AND coalesce(value, '') <> '' GROUP BY 1, 2""")
def mapping_reviewer_fields(spark, sf):
    return m.apply_reviewer_mappings(_fields(spark, sf), _mappings(spark, sf))[0]


@query("mapping_reviewer_log", "J21", "WITH " + v.AUDIT_LOG + """
SELECT actor_user_id AS cv_id, CASE k % 3 WHEN 0 THEN 'candidate.email' ELSE 'skills.primarySkills' END AS field, trim(error_message) AS new_value,
  'mapped from ' || module_name || '.' || id AS reason FROM audit_log WHERE k % 3 < 2 AND trim(coalesce(error_message, '')) <> ''""")
def mapping_reviewer_log(spark, sf):
    return m.apply_reviewer_mappings(_fields(spark, sf), _mappings(spark, sf))[2]


def _mappings(spark, sf):
    return v.audit_log(spark, sf).selectExpr(
        "actor_user_id AS cv_id", "id AS ordinal", "CASE k % 3 WHEN 0 THEN 'candidate.email' WHEN 1 THEN 'skills.primarySkills' ELSE 'other.thing' END AS target_path",
        "error_message AS value", "module_name AS source", "CAST(id AS STRING) AS key",
    )


@query("mapping_round_trip", "M18", P + " SELECT cv_id, full_name, email, phone, title, city, array_to_string(primary_skills, '|') AS primary_skills FROM profiles")
def mapping_round_trip(spark, sf):
    return m.to_legacy(m.to_canonical(p.profiles(spark, sf))).withColumn("primary_skills", F.array_join("primary_skills", "|"))


@query("mapping_preview", "M25", P + """
SELECT cv_id, full_name, trim(title) AS title, concat_ws(', ', nullif(city, ''), nullif(country, '')) AS location, coalesce(years || ' years', '') AS experience,
  array_to_string(primary_skills, ', ') AS skills, len(work) AS jobs FROM profiles""")
def mapping_preview(spark, sf):
    return m.preview_rows(p.profiles(spark, sf)).drop("projects", "domains").withColumn("jobs", F.col("jobs").cast("long"))


@query("mapping_repaired_edits", "M28", P + """,
e AS (SELECT cv_id, unnest(work) AS w, generate_subscripts(work, 1) AS i FROM profiles)
SELECT cv_id, i, CASE WHEN w.end_date = '' THEN 'audit.merge.operation.' || i ELSE w.end_date END AS field,
  coalesce(nullif(w.designation, ''), nullif(w.description, ''), 'merge') AS new_value, coalesce(nullif(w.organization, ''), 'system') AS edited_by FROM e""")
def mapping_repaired_edits(spark, sf):
    legacy = F.transform("work", lambda w: F.struct(
        w["end_date"].alias("field"), w["designation"].alias("new_value"), w["description"].alias("description"), F.lit("merge").alias("operation"),
        w["organization"].alias("edited_by"), F.lit("").alias("source_type"), F.lit(None).cast("timestamp_ntz").alias("edited_at"), F.lit("").alias("reason")))
    fixed = m.repair_edits(legacy, F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = p.profiles(spark, sf).select("cv_id", F.posexplode_outer(fixed).alias("i", "e")).where("e IS NOT NULL")
    return rows.select("cv_id", (F.col("i") + 1).cast("long").alias("i"), "e.field", "e.new_value", "e.edited_by")


@query("mapping_changed_fields", "W16", "WITH RECURSIVE " + p.PROFILES + ",\n" + p.PAGE_PROFILES + """,
a AS (SELECT cv_id, path, value FROM (UNPIVOT (SELECT cv_id, full_name, email, summary FROM profiles) ON full_name, email, summary INTO NAME path VALUE value)),
b AS (SELECT cv_id, path, value FROM (UNPIVOT (SELECT cv_id, full_name, email, summary FROM page_profiles) ON full_name, email, summary INTO NAME path VALUE value))
SELECT coalesce(a.cv_id, b.cv_id) AS cv_id, coalesce(a.path, b.path) AS path, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.cv_id = b.cv_id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def mapping_changed_fields(spark, sf):
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).alias("value")) for n in ("full_name", "email", "summary")])
    after = p.page_profiles(spark, sf).select("cv_id", F.explode(pairs).alias("f")).select("cv_id", "f.*")
    return m.changed_fields(_fields(spark, sf), after)


EXT_A = "map('a', c_name, 'b', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'old' END)"
EXT_B = "map('b', 'new', 'c', c_mktsegment)"


@query("mapping_extension_merge", "M10 W15", """
SELECT c_custkey AS cv_id, c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS b, c_mktsegment AS c,
  CASE WHEN c_custkey % 2 = 0 THEN 'modified_b|added_c' ELSE 'added_c' END AS changes FROM customer""")
def mapping_extension_merge(spark, sf):
    df = v.load(spark, sf, "customer").select("c_custkey", F.expr(EXT_A).alias("x"), F.expr(EXT_B).alias("y"))
    merged = df.withColumn("z", merge.merge_extension(F.col("x"), F.col("y")))
    changes = F.array_join(tracing.state_changes(F.col("x"), F.col("z")), "|")
    return merged.select(F.col("c_custkey").alias("cv_id"), *[F.col("z")[k].alias(k) for k in "abc"], changes.alias("changes"))
