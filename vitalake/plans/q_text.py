"""Registered queries: text functions, predicates, wording and guards over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.functions import text as t, values as V
from vitalake.plans import profiles as p, texts as tx, views as v
from vitalake.plans.registry import query

T = "WITH " + tx.TEXTS
P = "WITH " + p.PROFILES


def _any(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _hits(column: str, words) -> str:
    return "(" + " + ".join("contains({}, '{}')::INT".format(column, w.replace("'", "''")) for w in words) + ")"


def _replace_all(column: str, pairs) -> str:
    for old, new in pairs:
        column = "replace({}, '{}', '{}')".format(column, old.replace("'", "''"), new.replace("'", "''"))
    return column


ONE_EMAIL, ONE_PHONE = t.EMAIL_PATTERN, t.PHONE_PATTERN


@query("guard_pii", "G1 T4", T + f"""
SELECT doc_id, channel, regexp_matches(text, '{ONE_EMAIL}') OR regexp_matches(text, '{ONE_PHONE}') AS has_pii,
  md5(regexp_replace(regexp_replace(text, '{ONE_EMAIL}', '[REDACTED_EMAIL]', 'g'), '{ONE_PHONE}', '[REDACTED_PHONE]', 'g')) AS redacted FROM all_texts""")
def guard_pii(spark, sf):
    c = F.col("text")
    return tx.all_texts(spark, sf).select("doc_id", "channel", t.has_pii(c).alias("has_pii"), F.md5(t.redact_pii(c)).alias("redacted"))


SECRET_SQL = _replace_all("text", [(f, "[FILTERED]") for w in t.SECRET_TERMS for f in (w, w.upper())])


@query("guard_secrets_and_injection", "G2 G3", T + f"""
SELECT doc_id, channel, {_any('lower(text)', t.SECRET_TERMS)} AS has_secret, {_any('lower(text)', t.INJECTION_PHRASES)} AS injection,
  md5({SECRET_SQL}) AS filtered FROM all_texts""")
def guard_secrets_and_injection(spark, sf):
    c = F.col("text")
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", t.has_secret(c).alias("has_secret"), t.is_injection(c).alias("injection"), F.md5(t.filter_secrets(c)).alias("filtered")
    )


@query("guard_sanitized", "G4", T + f"""
SELECT doc_id, channel, md5(regexp_replace(regexp_replace({SECRET_SQL}, '{ONE_EMAIL}', '[REDACTED_EMAIL]', 'g'), '{ONE_PHONE}', '[REDACTED_PHONE]', 'g')) AS clean FROM all_texts""")
def guard_sanitized(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.md5(t.sanitize(F.col("text"))).alias("clean"))


FILLER = ", ".join(f"'{w}'" for w in t.FILLER_WORDS)


@query("text_predicates", "F15 F21 F22 F23", T + f"""
SELECT doc_id, channel, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w NOT IN ({FILLER}))) < 8 AS low_signal,
  {_hits('lower(text)', t.VOICE_CUES)} > greatest(0, {_hits('lower(text)', t.CONVERSATION_CUES)}) AS voice,
  {_hits('lower(text)', t.COMPREHENSIVE_CUES)} >= 3 OR ({_hits('lower(text)', t.COMPREHENSIVE_CUES)} >= 2 AND length(text) > 200) AS conversational,
  {_any('lower(text)', t.EXTRACTION_TRIGGERS)} AS should_extract FROM all_texts""")
def text_predicates(spark, sf):
    c = F.col("text")
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", t.low_signal(c).alias("low_signal"), t.is_voice_transcript(c).alias("voice"),
        t.is_conversational(c).alias("conversational"), t.should_extract(c).alias("should_extract"),
    )


@query("text_profile_predicates", "F16 F17 F18 F24", P + f"""
SELECT cv_id, full_name <> '' OR email <> '' OR phone <> '' OR summary <> '' OR title <> '' OR organization <> '' OR len(education) > 0 OR len(projects) > 0
    OR len(work) > 0 OR len(certs) > 0 AS meaningful,
  lower(trim(full_name)) IN ({', '.join(f"'{g}'" for g in t.GREETINGS)}) AS greeting,
  len(list_filter(projects, lambda x: x.name IN ({', '.join(f"'{n}'" for n in t.INVALID_PROJECT_NAMES)}) OR (x.client = '' AND len(x.technologies) = 0 AND x.description = ''
    AND len(x.responsibilities) = 1 AND lower(trim(x.responsibilities[1], ' .,:;')) = 'worked on ' || x.name))) AS placeholder_projects,
  len(projects) = 0 OR len(list_filter(projects, lambda x: x.name = '' OR x.description = '')) > 0 AS needs_enhancement,
  len(list_filter(projects, lambda x: x.description <> '' OR len(x.responsibilities) > 0 OR len(x.technologies) > 0)) = 0 AS sparse FROM profiles""")
def text_profile_predicates(spark, sf):
    from vitalake.operators.extract import meaningful_profile

    df = p.profiles(spark, sf)
    return df.select(
        "cv_id", meaningful_profile(df).alias("meaningful"), t.placeholder_name(F.col("full_name")).alias("greeting"),
        F.size(F.filter("projects", t.placeholder_project)).cast("long").alias("placeholder_projects"),
        t.needs_enhancement(F.col("projects")).alias("needs_enhancement"), t.sparse_projects(F.col("projects")).alias("sparse"),
    )


@query("text_normalized", "X5 X6 X14 X15 X16", T + """
SELECT doc_id, channel, md5(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ,', ','), ' .', '.')) AS transcript,
  md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS label, regexp_matches(trim(text), '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') AS is_date FROM all_texts""")
def text_normalized(spark, sf):
    from vitalake.operators.unmapped import normalize_label

    c = F.col("text")
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", F.md5(t.normalize_transcript(t.strip_control_chars(c))).alias("transcript"), F.md5(normalize_label(c)).alias("label"),
        t.is_canonical_date(c).alias("is_date"),
    )


SKILL_LEAD = (
    "^(my\\s+)?(primary|secondary|supporting|key|core)?\\s*(skills|skill|technology|technologies|tools|tool|platforms|platform|frameworks|framework)"
    "\\s*(is|are|includes|include|:)?\\s*"
)


@query("text_skill_lists", "X8", T + f""", s AS (SELECT doc_id, channel, unnest(string_split_regex(text, '[.]')) AS sentence, generate_subscripts(string_split_regex(text, '[.]'), 1) AS n FROM all_texts),
c AS (SELECT doc_id, channel, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(sentence), chr(10), ', '), '\\s+and\\s+', ', ', 'gi'), '[;/]+', ', ', 'g'),
  '\\s+(\\||-|&)\\s+', ', ', 'g'), '{SKILL_LEAD}', '', 'i') AS x FROM s)
SELECT doc_id, channel, n, array_to_string(list_transform(list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: y <> ''), lambda y: rtrim(y, '.')), '|') AS items FROM c""")
def text_skill_lists(spark, sf):
    rows = tx.all_texts(spark, sf).select("doc_id", "channel", F.posexplode(F.split("text", "[.]")).alias("n", "sentence"))
    return rows.select(
        "doc_id", "channel", (F.col("n") + 1).cast("long").alias("n"), F.array_join(t.parse_skill_list(F.trim("sentence")), "|").alias("items")
    )


@query("text_dictionaries", "X28 X29 E14", T + f"""
SELECT doc_id, channel, concat_ws('|', {', '.join(f"CASE WHEN contains(lower(text), '{d}') THEN '{d.title()}' END" if d not in ('ecommerce', 'e-commerce') else "CASE WHEN contains(lower(text), 'ecommerce') OR contains(lower(text), 'e-commerce') THEN 'E-Commerce' END" for d in t.DOMAINS if d != 'e-commerce')}) AS plain_domains,
  concat_ws('|', CASE WHEN contains(lower(text), 'mysql') THEN 'MySQL' END, CASE WHEN contains(lower(text), 'postgres') THEN 'PostgreSQL' END,
    CASE WHEN contains(lower(text), 'oracle') THEN 'Oracle' END, CASE WHEN contains(lower(text), 'sql server') THEN 'SQL Server' END,
    CASE WHEN contains(lower(text), 'mongodb') THEN 'MongoDB' END, CASE WHEN contains(lower(text), 'db2') THEN 'DB2' END) AS databases,
  concat_ws('|', CASE WHEN contains(lower(text), 'aws') OR contains(lower(text), 'amazon web services') THEN 'AWS' END,
    CASE WHEN contains(lower(text), 'azure') THEN 'Azure' END, CASE WHEN contains(lower(text), 'gcp') OR contains(lower(text), 'google cloud') THEN 'GCP' END) AS clouds,
  concat_ws('|', CASE WHEN contains(s, 'linux') THEN 'Linux' END, CASE WHEN contains(s, 'windows') THEN 'Windows' END) AS systems
FROM (SELECT *, coalesce(nullif(regexp_extract(lower(text), 'operating systems?[^.]*?(linux and windows|linux|windows)', 1), ''),
  nullif(regexp_extract(lower(text), '(?:experience with|familiar with|work with) (linux and windows|linux|windows)', 1), ''),
  nullif(regexp_extract(lower(text), '(linux and windows|linux|windows) operating systems?', 1), '')) AS s FROM all_texts)""")
def text_dictionaries(spark, sf):
    c = F.col("text")
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", F.array_join(t.domains_in_text(c), "|").alias("plain_domains"),
        F.array_join(t.databases_in_text(c), "|").alias("databases"), F.array_join(t.clouds_in_text(c), "|").alias("clouds"),
        F.array_join(t.systems_in_text(c), "|").alias("systems"),
    )


def _case(column: str, table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, k)} THEN '{n}'" for n, k in table.items()) + f" {other} END"


@query("text_skill_categories", "X25 X26", P + f"""
SELECT category, skill_group, level, count(*) AS skills FROM (
  SELECT {_case('s', t.SKILL_CATEGORIES, "ELSE 'other'")} AS category, coalesce({_case('s', t.SKILL_GROUPS, '')}, '') AS skill_group,
    CASE WHEN years >= 5 THEN 'Expert' WHEN years >= 3 THEN 'Advanced' ELSE 'Intermediate' END AS level
  FROM (SELECT years, unnest(primary_skills) AS s FROM profiles)) GROUP BY ALL""")
def text_skill_categories(spark, sf):
    skills = p.profiles(spark, sf).select("years", F.explode("primary_skills").alias("s"))
    return skills.groupBy(
        t.categorize_skill(F.col("s")).alias("category"), F.coalesce(t.skill_group(F.col("s")), F.lit("")).alias("skill_group"),
        t.proficiency(F.col("years")).alias("level"),
    ).agg(F.count(F.lit(1)).alias("skills"))


METRICS_SQL = "list_concat(" * 4 + "regexp_extract_all(text, '{}'), regexp_extract_all(text, '{}')), regexp_extract_all(text, '{}')), regexp_extract_all(text, '{}')), regexp_extract_all(text, '{}'))".format(*t.METRIC_PATTERNS)


@query("text_metrics", "X22", T + f" SELECT doc_id, channel, array_to_string({METRICS_SQL}, '|') AS metrics FROM all_texts")
def text_metrics(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.array_join(t.metrics_in_text(F.col("text")), "|").alias("metrics"))


def _weak_sql(column: str) -> str:
    for weak, strong in t.WEAK_WORDS.items():
        column = f"regexp_replace({column}, '{weak}', '{strong}', 'i')"
    return column


def _weak_count(column: str) -> str:
    parts = []
    for weak, strong in t.WEAK_WORDS.items():
        parts.append(f"contains(lower({column}), '{weak}')::INT")
        column = f"regexp_replace({column}, '{weak}', '{strong}', 'i')"
    return "(" + " + ".join(parts) + ")"


@query("text_weak_words", "X23", T + f" SELECT doc_id, channel, md5({_weak_sql('text')}) AS rewritten FROM all_texts")
def text_weak_words(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.md5(t.replace_weak_words(F.col("text"))).alias("rewritten"))


POWER = [w for words in t.POWER_WORDS.values() for w in words]


@query("text_enhanced", "X24", T + f""", w AS (SELECT doc_id, channel, trim(text) AS o, {_weak_sql('trim(text)')} AS x, len({METRICS_SQL}) > 0 AS m, text FROM all_texts),
p AS (SELECT *, {_weak_count('o')} AS wk, NOT {_any('lower(x)', POWER)} AND NOT (upper(x[1]) = x[1] AND lower(x[1]) <> x[1]) AS add FROM w),
q AS (SELECT *, CASE WHEN add THEN 'Achieved ' || x ELSE x END AS y FROM p),
r AS (SELECT *, CASE WHEN contains(lower(y), 'implemented') AND NOT contains(lower(y), 'resulting in') THEN y || ' with measurable business impact' ELSE y END AS z FROM q),
e AS (SELECT *, CASE WHEN NOT {_any('lower(z)', t.ROLE_KEYWORDS['architect'])} THEN z || ' demonstrating design' ELSE z END AS final FROM r)
SELECT doc_id, channel, md5(CASE WHEN o = '' THEN text ELSE final END) AS enhanced, CASE WHEN o = '' THEN 1 ELSE round(least(1, greatest(0, 1.0::DOUBLE - CASE WHEN m::INT + least(3, wk) + add::INT + 1 < 2 THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN length(final) > length(o) * 1.5 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN m THEN 0.1::DOUBLE ELSE 0 END)), 6) END AS confidence FROM e""")
def text_enhanced(spark, sf):
    return t.enhance_text(tx.all_texts(spark, sf), role="architect").select("doc_id", "channel", F.md5("enhanced").alias("enhanced"), "confidence")


@query("text_cleanup", "X34", T + ", c AS (SELECT doc_id, channel, trim(regexp_replace({}, '\\s+', ' ', 'g')) AS x FROM all_texts) "
       "SELECT doc_id, channel, md5(CASE WHEN x <> '' AND NOT ends_with(x, '.') THEN x || '.' ELSE x END) AS clean FROM c".format(
           _replace_all("text", [(f, n) for o, n in t.CLEANUP_PHRASES.items() for f in (o, o.title())])))
def text_cleanup(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.md5(t.cleanup_phrases(F.col("text"))).alias("clean"))


@query("text_list_items", "X35", P + """, i AS (SELECT cv_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '\\n|,')), '^[-*•]\\s*', '')) AS x,
  generate_subscripts(regexp_split_to_array(text, '\\n|,'), 1) AS n FROM profiles),
d AS (SELECT * FROM i WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY cv_id, lower(x) ORDER BY n) = 1)
SELECT cv_id, count(*) AS items, md5(string_agg(x, '|' ORDER BY n)) AS content FROM d GROUP BY 1""")
def text_list_items(spark, sf):
    df = p.profiles(spark, sf).select("cv_id", t.normalize_text_list(F.array("text")).alias("i")).where("size(i) > 0")
    return df.select("cv_id", F.size("i").cast("long").alias("items"), F.md5(F.array_join("i", "|")).alias("content"))


@query("text_summary_sentence", "X36", P + """, s AS (SELECT cv_id, CASE WHEN years IS NULL THEN '' ELSE years || ' years' END AS y, trim(title) AS role, certs, primary_skills, lines, organization FROM profiles),
c AS (SELECT cv_id, CASE WHEN y <> '' AND role <> '' THEN 'Accomplished ' || role || ' with ' || y || ' of progressive experience' WHEN y <> '' THEN 'Professional with ' || y || ' of experience' ELSE 'Experienced professional' END AS a,
  CASE WHEN len(certs) > 0 THEN 'in ' || array_to_string(certs[1:3], ', ') ELSE '' END AS b,
  CASE WHEN len(primary_skills) > 0 THEN '. Expertise in ' || array_to_string(primary_skills[1:4], ', ') ELSE '' END AS c,
  CASE WHEN len(lines) > 0 THEN '. ' || lines[1] ELSE '' END AS d, CASE WHEN organization <> '' THEN '. Focused on advancing in ' || organization || ' roles' ELSE '' END AS e FROM s),
t AS (SELECT *, trim(a || ' ' || b || ' ' || c || ' ' || d || ' ' || e) AS sentence FROM c)
SELECT cv_id, md5(sentence) AS sentence, round(least(1, CASE WHEN length(sentence) BETWEEN 150 AND 500 THEN 0.3::DOUBLE ELSE 0 END
  + ((a <> '')::INT + (b <> '')::INT + (c <> '')::INT + (d <> '')::INT + (e <> '')::INT) / 5 * 0.4::DOUBLE
  + (contains(lower(sentence), 'experience')::INT + contains(lower(sentence), 'expertise')::INT + contains(lower(sentence), 'skill')::INT + contains(lower(sentence), 'professional')::INT) / 4 * 0.3::DOUBLE), 6) AS quality FROM t""")
def text_summary_sentence(spark, sf):
    df = p.profiles(spark, sf)
    years = F.when(F.col("years").isNull(), "").otherwise(F.concat(F.col("years").cast("string"), F.lit(" years")))
    text, quality = t.summary_template(years, F.trim("title"), F.col("certs"), F.col("primary_skills"), F.col("lines"), F.col("organization"))
    return df.select("cv_id", F.md5(text).alias("sentence"), quality.alias("quality"))


@query("text_star_projects", "X37", P + """, e AS (SELECT cv_id, title, unnest(projects) AS x, generate_subscripts(projects, 1) AS n FROM profiles)
SELECT cv_id, n, md5('Project: ' || x.name || CASE WHEN x.client <> '' THEN ' for ' || x.client ELSE '' END || CASE WHEN title <> '' THEN '. Served as ' || title ELSE '' END
  || CASE WHEN len(x.responsibilities) > 0 THEN '. Key contributions: ' || array_to_string(x.responsibilities[1:3], '; ') ELSE '' END) AS star FROM e""")
def text_star_projects(spark, sf):
    rows = p.profiles(spark, sf).select("cv_id", "title", F.posexplode("projects").alias("n", "x"))
    return rows.select("cv_id", (F.col("n") + 1).cast("long").alias("n"), F.md5(t.star_description(F.col("x"), F.col("title"), F.lit(""))).alias("star"))


@query("text_answer_features", "X32", "WITH " + v.ANSWERS + f""",
f AS (SELECT *, CASE WHEN trim(answer) = '' THEN 0 ELSE len(regexp_split_to_array(trim(answer), '\\s+')) END AS n, {_any('lower(answer)', t.VAGUE_MARKERS)} AS vague FROM answers)
SELECT session_id, ordinal, n AS word_count, n < 8 AS is_short, n < 4 OR vague AS needs_followup,
  contains(answer, '%') OR contains(answer, '$') OR {_any('lower(answer)', t.METRIC_WORDS)} AS has_metric, vague AS is_vague FROM f""")
def text_answer_features(spark, sf):
    f = t.answer_features(F.col("answer"))
    return v.answers(spark, sf).select("session_id", "ordinal", f.pop("word_count").cast("long").alias("word_count"), *[c.alias(n) for n, c in f.items()])


@query("text_locations_and_durations", "X9 X11 X12", T + """, l AS (SELECT doc_id, channel, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS n FROM all_texts),
q AS (SELECT *, list_transform(string_split(s, ','), lambda x: trim(x)) AS ps, regexp_extract(trim(regexp_extract(lower(s), '(?s)^(.*?)year', 1)), '(\\S+)$', 1) AS yw,
  regexp_extract(trim(regexp_extract(lower(s), '(?s)^(.*?)month', 1)), '(\\S+)$', 1) AS mw FROM l),
d AS (SELECT *, CASE WHEN regexp_matches(yw, '^[0-9]+$') THEN yw::INT ELSE 0 END AS y, CASE WHEN regexp_matches(mw, '^[0-9]+$') THEN mw::INT ELSE 0 END AS m FROM q)
SELECT doc_id, channel, n, ps[1] AS city, CASE WHEN len(ps) > 2 THEN ps[2] ELSE '' END AS state, CASE WHEN len(ps) > 1 THEN ps[-1] ELSE '' END AS country,
  (y + m // 12)::INT AS years, (m % 12)::INT AS months,
  CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN trim(s)::DOUBLE END AS number FROM d""")
def text_locations_and_durations(spark, sf):
    rows = tx.all_texts(spark, sf).select("doc_id", "channel", F.posexplode(F.split("text", "[.]")).alias("n", "s"))
    out = rows.withColumns({"l": t.location_parts(F.col("s")), "d": t.duration_parts(F.col("s")), "x": t.number_or_text(F.col("s"))})
    return out.select("doc_id", "channel", (F.col("n") + 1).cast("long").alias("n"), "l.city", "l.state", "l.country", "d.years", "d.months", "x.number")


@query("text_ids", "X19", T + """
SELECT doc_id, channel, md5(text)[1:16] AS content_id, md5(channel || text) AS typed_id FROM all_texts""")
def text_ids(spark, sf):
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", t.content_id(F.col("text")).alias("content_id"), t.typed_id(F.col("channel"), F.col("text")).alias("typed_id")
    )


@query("text_hash_embedding", "X20 P4", T + """, h AS (SELECT doc_id, channel, sha256(text) AS d FROM all_texts),
r AS (SELECT doc_id, channel, list_transform(generate_series(0, 7), lambda i: ('0x' || d[1 + 8 * i : 8 + 8 * i])::BIGINT / 4294967296.0::DOUBLE) AS x FROM h)
SELECT doc_id, channel, array_to_string(list_transform(x, lambda y: round(y / sqrt(list_sum(list_transform(x, lambda z: z * z))), 6)::DECIMAL(9, 6)), ',') AS vec FROM r""")
def text_hash_embedding(spark, sf):
    vec = F.transform(t.hash_embedding(F.col("text")), lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string"))
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.array_join(vec, ",").alias("vec"))


@query("text_spoken_email", "X31", T + r""", m AS (SELECT doc_id, channel,
  regexp_extract(text, '(?i)([A-Za-z0-9_.\-]+)\s+(?:at|@)\s+([A-Za-z0-9_.\-]+)\s+(?:dot|\.)\s+(com|org|net|io|in|co|edu)', ['a', 'b', 'c']) AS s,
  regexp_extract(text, '(?i)([A-Za-z0-9_.\-]+)\.([A-Za-z0-9_.\-]+)\.(com|org|net|io|in|co|edu)', ['a', 'b', 'c']) AS d FROM all_texts)
SELECT doc_id, channel, CASE WHEN s.a <> '' THEN s.a || '@' || s.b || '.' || lower(s.c) WHEN d.a <> '' THEN d.a || '@' || d.b || '.' || lower(d.c) END AS email FROM m""")
def text_spoken_email(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", t.spoken_email(F.col("text")).alias("email"))


@query("text_highlights", "X33", T + """, l AS (SELECT doc_id, channel, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND (contains(lower(x), 'java') OR contains(lower(x), 'the'))) AS ls FROM all_texts)
SELECT doc_id, channel, array_to_string(ls[1:3], chr(10)) AS lines FROM l""")
def text_highlights(spark, sf):
    found = t.highlights(F.col("text"), F.array(F.lit("java"), F.lit("the")))
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.array_join(found, "\n").alias("lines"))


@query("text_flat_skills", "X13", P + """
SELECT cv_id, array_to_string(list_filter(list_transform(list_concat(primary_skills, list_concat(secondary_skills, [' ', ' x '])), lambda s: trim(s)), lambda s: s <> ''), '|') AS skills FROM profiles""")
def text_flat_skills(spark, sf):
    groups = F.create_map(
        F.lit("primary"), F.col("primary_skills"), F.lit("secondary"), F.col("secondary_skills"), F.lit("tools"), F.array(F.lit(" "), F.lit(" x "))
    )
    return p.profiles(spark, sf).select("cv_id", F.array_join(t.skills_flatten(groups), "|").alias("skills"))


@query("text_truthy", "X7", T + """
SELECT doc_id, channel, trim(coalesce(text, '')) <> '' AS text_set, length(text) % 3 <> 0 AS number_set, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: true)) > 0 AS list_set,
  doc_id % 2 = 0 AS flag_set FROM all_texts""")
def text_truthy(spark, sf):
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return tx.all_texts(spark, sf).select(
        "doc_id", "channel", V.truthy(F.col("text"), "string").alias("text_set"), V.truthy(F.length("text") % 3, "number").alias("number_set"),
        V.truthy(numbers, "array").alias("list_set"), V.truthy(F.col("doc_id") % 2 == 0, "boolean").alias("flag_set"))


@query("text_whole_word_domains", "X28", "WITH " + tx.TEXTS + """
SELECT doc_id, channel, array_to_string(list_filter(['Healthcare', 'Insurance', 'Banking', 'Finance', 'Retail', 'Telecom', 'Manufacturing', 'Pharma', 'Energy', 'Education'],
  lambda d: regexp_matches(lower(text), '\\b' || lower(d) || '\\b')), '|') AS domains FROM all_texts""")
def text_whole_word_domains(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.array_join(t.whole_word_domains(F.col("text")), "|").alias("domains"))
