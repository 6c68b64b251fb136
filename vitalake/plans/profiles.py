"""Nested profile records built row by row from text (no shuffle), in Spark and DuckDB.

One record per document (or page): the record is as large as its own text, so
no list ever grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalake.functions.markup import page_text
from vitalake.plans import views as v

# first and second word of a line, without taking the rest apart; '' if there is none
_W1 = "regexp_extract(l, '[A-Za-z]+', 0)"
_W2 = "regexp_extract(l, '[A-Za-z]++[^A-Za-z]++([A-Za-z]+)', 1)"

_SPARK_STEPS = [
    {
        "words": r"regexp_extract_all(text, '[A-Za-z]+', 0)",
        "lines": r"filter(split(text, '\n'), l -> trim(l) <> '')",
    },
    {
        "full_name": "CASE WHEN cv_id % 9 = 0 THEN '' ELSE concat_ws(' ', get(words, 0), get(words, 1)) END",
        "email": r"CASE WHEN NOT contains(text, '@') THEN '' ELSE regexp_extract(text, '[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 0) END",
        "phone": r"regexp_extract(text, '(?=[+0-9])[+]?[0-9][0-9 ()-]{7,}[0-9]', 0)",
        "title": "CASE cv_id % 8 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'technical manager' WHEN 2 THEN ' Solution Architect' "
        "WHEN 3 THEN 'Project Manager' WHEN 4 THEN 'Data Analyst' WHEN 5 THEN '' WHEN 6 THEN 'HR Manager' ELSE 'Senior Developer' END",
        "organization": "CASE WHEN cv_id % 5 = 0 THEN '' ELSE upper(coalesce(get(words, 2), '')) END",
        "years": "CASE WHEN cv_id % 11 = 0 THEN NULL ELSE CAST(length(text) % 65 - 3 AS INT) END",
        "summary": "CASE WHEN cv_id % 6 = 0 THEN '' ELSE coalesce(get(lines, 0), '') END",
        "city": "initcap(coalesce(get(words, 3), ''))",
        "country": "CASE WHEN cv_id % 4 = 0 THEN '' ELSE upper(coalesce(get(words, 4), '')) END",
        "primary_skills": "array_distinct(transform(filter(words, w -> length(w) >= 10), w -> lower(w)))",
        "secondary_skills": "filter(words, w -> length(w) = 8)",
        "certs": "array_distinct(filter(words, w -> length(w) = 9 AND upper(left(w, 1)) = left(w, 1)))",
        "projects": "transform(lines, (l, i) -> named_struct("
        f"'name', lower(rtrim(concat({_W1}, ' ', {_W2}))), "
        "'client', CASE WHEN i % 2 = 0 THEN 'internal' ELSE '' END, "
        "'description', CASE WHEN length(l) % 10 = 0 THEN '' ELSE l END, "
        "'technologies', filter(regexp_extract_all(l, '[A-Za-z]+', 0), w -> length(w) >= 9), "
        r"'responsibilities', filter(split(l, '[.] ?'), p -> length(p) >= 20)))",
        "work": "transform(lines, (l, i) -> named_struct("
        f"'organization', upper({_W1}), "
        f"'designation', {_W2}, "
        "'start_date', concat(CAST(1990 + length(l) % 30 AS STRING), '-01'), "
        "'end_date', CASE WHEN length(l) % 7 = 0 THEN '' ELSE concat(CAST(1990 + length(l) % 30 + length(l) % 5 - 1 AS STRING), '-06') END, "
        "'description', l))",
        "education": "transform(filter(lines, l -> length(l) < 60), l -> named_struct("
        "'degree', CASE length(l) % 4 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'MBA' WHEN 2 THEN 'PhD' ELSE '' END, "
        f"'institution', {_W2}, "
        "'year', CASE WHEN length(l) % 3 = 0 THEN '' ELSE CAST(1970 + length(l) AS STRING) END))",
    },
]


def _build(df: DataFrame) -> DataFrame:
    for step in _SPARK_STEPS:
        df = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in step.items()])
    return df


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(v.load_spread(spark, sf_dir, "documents", "doc_id").selectExpr("doc_id AS cv_id", "text"))


def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records for the merge: the same shape, read from web pages."""
    pages = v.load_spread(spark, sf_dir, "pages", "page_id")
    return _build(pages.select(pages.page_id.alias("cv_id"), page_text(pages.html).alias("text")))


def _sql(name: str, source: str) -> str:
    w = "regexp_extract_all({}, '[A-Za-z]+')"
    return f"""{name}_w AS MATERIALIZED (
  SELECT cv_id, text, regexp_extract_all(text, '[A-Za-z]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS lines FROM ({source})),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN cv_id % 9 = 0 THEN '' ELSE concat_ws(' ', words[1], words[2]) END AS full_name,
    regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') AS email,
    regexp_extract(text, '[+]?[0-9][0-9 ()-]{{7,}}[0-9]') AS phone,
    CASE cv_id % 8 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'technical manager' WHEN 2 THEN ' Solution Architect'
      WHEN 3 THEN 'Project Manager' WHEN 4 THEN 'Data Analyst' WHEN 5 THEN '' WHEN 6 THEN 'HR Manager' ELSE 'Senior Developer' END AS title,
    CASE WHEN cv_id % 5 = 0 THEN '' ELSE upper(coalesce(words[3], '')) END AS organization,
    CASE WHEN cv_id % 11 = 0 THEN NULL ELSE (length(text) % 65 - 3)::INT END AS years,
    CASE WHEN cv_id % 6 = 0 THEN '' ELSE coalesce(lines[1], '') END AS summary,
    coalesce(upper(words[4][1]) || lower(words[4][2:]), '') AS city,
    CASE WHEN cv_id % 4 = 0 THEN '' ELSE upper(coalesce(words[5], '')) END AS country,
    (WITH t AS (SELECT lower(u) AS u, i FROM (SELECT unnest(words) AS u, generate_subscripts(words, 1) AS i) WHERE length(u) >= 10)
      SELECT coalesce(list(u ORDER BY i), []) FROM (SELECT u, min(i) AS i FROM t GROUP BY u)) AS primary_skills,
    list_filter(words, lambda x: length(x) = 8) AS secondary_skills,
    (WITH t AS (SELECT u, i FROM (SELECT unnest(words) AS u, generate_subscripts(words, 1) AS i) WHERE length(u) = 9 AND upper(u[1]) = u[1])
      SELECT coalesce(list(u ORDER BY i), []) FROM (SELECT u, min(i) AS i FROM t GROUP BY u)) AS certs,
    list_transform(lines, lambda l, i: {{
      'name': lower(array_to_string({w.format('l')}[1:2], ' ')), 'client': CASE WHEN i % 2 = 1 THEN 'internal' ELSE '' END,
      'description': CASE WHEN length(l) % 10 = 0 THEN '' ELSE l END,
      'technologies': list_filter({w.format('l')}, lambda x: length(x) >= 9),
      'responsibilities': list_filter(regexp_split_to_array(l, '[.] ?'), lambda p: length(p) >= 20)}}) AS projects,
    list_transform(lines, lambda l: {{
      'organization': upper(coalesce({w.format('l')}[1], '')), 'designation': coalesce({w.format('l')}[2], ''),
      'start_date': (1990 + length(l) % 30)::VARCHAR || '-01',
      'end_date': CASE WHEN length(l) % 7 = 0 THEN '' ELSE (1990 + length(l) % 30 + length(l) % 5 - 1)::VARCHAR || '-06' END,
      'description': l}}) AS work,
    list_transform(list_filter(lines, lambda l: length(l) < 60), lambda l: {{
      'degree': CASE length(l) % 4 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'MBA' WHEN 2 THEN 'PhD' ELSE '' END,
      'institution': coalesce({w.format('l')}[2], ''),
      'year': CASE WHEN length(l) % 3 = 0 THEN '' ELSE (1970 + length(l))::VARCHAR END}}) AS education
  FROM {name}_w)"""


PAGE_TEXT_SQL = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), "
    "'(?s)<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), "
    "'[ \\t\\r]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), chr(10) || ' ')"
)
PROFILES = _sql("profiles", "SELECT doc_id AS cv_id, text FROM documents")
PAGE_PROFILES = _sql("page_profiles", f"SELECT page_id AS cv_id, {PAGE_TEXT_SQL} AS text FROM pages")
