"""Registered queries: text to fields over transcripts, resumes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalake.functions.text import INVALID_PROJECT_NAMES
from vitalake.operators import extract as e
from vitalake.plans import profiles as p, texts as tx
from vitalake.plans.registry import query

T = "WITH " + tx.TEXTS
P = "WITH " + p.PROFILES


def _rx(pattern: str, index: int = 1, column: str = "text") -> str:
    return "nullif(regexp_extract({}, '{}', {}), '')".format(column, pattern.replace("'", "''"), index)


def _unpivot(source: str, fields: dict[str, tuple[str, str, float]]) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, channel, '{n}' AS field, {x} AS value, '{m}' AS method, {c}::DOUBLE AS confidence FROM {source} WHERE {x} <> ''"
        for n, (x, m, c) in fields.items()
    )


PHONE_1 = _rx(r"\+?[0-9]{1,3}[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}", 0)
PHONE_2 = _rx(r"[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", 0)
OK_PHONE = r"regexp_matches(regexp_replace({}, '[-.\s()]', '', 'g'), '^[0-9]{{10,15}}$')"
Y1, Y2 = _rx(r"(?i)([0-9]+)\+?\s*years?\s*(?:of\s*)?experience"), _rx(r"(?i)experience[:\s]+([0-9]+)\+?\s*years?")


@query("extract_contacts", "E1 P3", T + f""", c AS (SELECT doc_id, channel, {_rx(e.EMAIL, 0)} AS email, {PHONE_1} AS p1, {PHONE_2} AS p2,
  coalesce({_rx('(?i)linkedin[.]com/in/[A-Za-z0-9_-]+', 0)}, {_rx('(?i)linkedin[.]com/pub/[A-Za-z0-9_-]+', 0)}) AS linkedin, {_rx('(?i)github[.]com/[A-Za-z0-9_-]+', 0)} AS github, {Y1} AS y1, {Y2} AS y2 FROM all_texts),
d AS (SELECT *, coalesce(CASE WHEN {OK_PHONE.format('p1')} THEN p1 END, CASE WHEN {OK_PHONE.format('p2')} THEN p2 END) AS phone,
  coalesce(CASE WHEN try_cast(y1 AS INT) BETWEEN 0 AND 50 THEN y1 END, CASE WHEN try_cast(y2 AS INT) BETWEEN 0 AND 50 THEN y2 END) AS years FROM c)
""" + _unpivot("d", {"email": ("email", "pattern", .95), "phone": ("phone", "pattern", .85), "linkedin": ("linkedin", "pattern", .9), "github": ("github", "pattern", .9), "years_experience": ("years", "pattern", .75)}))
def extract_contacts(spark, sf):
    return e.extract_contacts(tx.all_texts(spark, sf))


WL = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
CAP = "len(list_filter(" + WL + ", lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("extract_head", "E2 E3", T + f""", h AS (SELECT doc_id, channel, list_transform(string_split(text, chr(10)), lambda l: trim(l)) AS ls FROM all_texts),
d AS (SELECT doc_id, channel, list_filter(ls[1:5], lambda l: len({WL.format('l')}) BETWEEN 2 AND 4 AND {CAP.format('l')} AND NOT {_any('lower(l)', e.NAME_STOP_WORDS)})[1] AS name,
  list_filter(ls[1:10], lambda l: {_any('lower(l)', e.TITLE_WORDS)} AND len({WL.format('l')}) BETWEEN 2 AND 6)[1] AS title FROM h)
""" + _unpivot("d", {"full_name": ("name", "rule", .8), "current_title": ("title", "rule", .75)}))
def extract_head(spark, sf):
    return e.extract_head(tx.all_texts(spark, sf))


YEARS6 = [
    r"(?i)([0-9]+)\s+years?\s+(?:of\s+)?experience", r"(?i)experience\s+of\s+([0-9]+)\s+years?", r"(?i)(?:have|had)\s+(?:like\s+)?([0-9]+)\s+years",
    r"(?i)(?:I\s+have)\s+([0-9]+)\s+years", r"(?i)(?:worked|working)\s+.*?\s+for\s+([0-9]+)\s+years", r"(?i)for\s+([0-9]+)\s+years",
]
YEARS6_SQL = "coalesce(" + ", ".join(f"CASE WHEN try_cast({_rx(y)} AS INT) BETWEEN 0 AND 60 THEN {_rx(y)} END" for y in YEARS6) + ")"
PHONES_SQL = "coalesce(" + ", ".join(f"CASE WHEN length(regexp_replace({_rx(q, 0)}, '[^0-9]', '', 'g')) >= 10 THEN {_rx(q, 0)} END" for q in e.PHONES) + ")"


@query("extract_ids", "E5 E6 E25", T + f""", d AS (SELECT doc_id, channel, {_rx(e.ID_CUE)} AS employee_id, {_rx(e.GRADE_CUE)} AS grade, {PHONES_SQL} AS phone, {YEARS6_SQL} AS years FROM all_texts)
""" + _unpivot("d", {"employee_id": ("employee_id", "pattern", .9), "grade": ("grade", "pattern", .9), "phone": ("phone", "pattern", .9), "years": ("years", "pattern", .85)}))
def extract_ids(spark, sf):
    return e.extract_ids(tx.all_texts(spark, sf))


@query("extract_spoken_experience", "E5", T + r""", d AS (SELECT doc_id, channel, coalesce(try_cast(coalesce(nullif(regexp_extract(lower(text), '([0-9]+)\s+years?\s+of\s+experience', 1), ''),
  nullif(regexp_extract(lower(text), 'experience\s+of\s+([0-9]+)\s+years?', 1), ''), nullif(regexp_extract(lower(text), '([0-9]+)\s+years?\s+experience', 1), '')) AS INT), 0) AS y,
  coalesce(try_cast(nullif(regexp_extract(lower(text), '([0-9]+)\s+months?\s+(?:of\s+)?experience', 1), '') AS INT), 0) AS m FROM all_texts)
SELECT doc_id, channel, (y + m // 12)::INT AS years, (m % 12)::INT AS months FROM d""")
def extract_spoken_experience(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", e.spoken_experience(F.col("text")).alias("d")).select("doc_id", "channel", "d.*")


@query("extract_location", "E26", T + r""", h AS (SELECT doc_id, channel, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS head FROM all_texts),
l AS (SELECT *, trim(nullif(regexp_extract(head, '(?i)(?:^|\n)\s*(?:location|address)\s*[:\-]\s*([^\n|]+)', 1), '')) AS label,
  regexp_extract(head, '(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})(?:[^A-Za-z0-9_]|$)', ['c', 's']) AS pair FROM h),
ps AS (SELECT *, list_filter(list_transform(string_split(label, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM l)
SELECT doc_id, channel, CASE WHEN label IS NOT NULL THEN parts[1] ELSE nullif(pair.c, '') END AS city, CASE WHEN label IS NOT NULL THEN parts[2] ELSE nullif(pair.s, '') END AS state,
  CASE WHEN label IS NOT NULL THEN parts[3] END AS country FROM ps""")
def extract_location(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", e.labelled_location(F.col("text")).alias("l")).select("doc_id", "channel", "l.*")


@query("extract_deterministic", "E4", T + r""", s AS (SELECT doc_id, channel, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM all_texts),
d AS (SELECT doc_id, channel, regexp_extract(text, '[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z0-9_]+') AS email,
  regexp_extract(text, '(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}') AS phone, regexp_extract(text, '(?i)([0-9]+)\s*years?\s+of\s+experience', 1) AS years,
  trim(array_to_string(ls[1:3], ' ')[1:300]) AS summary,
  array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '(?i)(?:skills?|expertise?|technologies?|tech stack)[\s:]+([^.]+)', 1), '[,/]|and'), lambda x: trim(x)), lambda x: x <> '')[1:5], '|') AS skills,
  trim(regexp_extract(text, '(?:at|with|worked\s+at|employed\s+at|work(?:ed)?\s+at)\s+([A-Z][A-Za-z\s&]+)', 1)) AS organization,
  trim(regexp_extract(text, '(?i)(?:as|role|position|title|worked\s+as)\s+(?:a|an)?\s+([A-Za-z\s]+?)(?:\s+at|,|\.|$)', 1)) AS title,
  CASE WHEN contains(lower(text), 'bachelor') THEN 'Bachelor' WHEN contains(lower(text), 'master') THEN 'Master' WHEN contains(lower(text), 'diploma') THEN 'Diploma'
    WHEN contains(lower(text), 'degree') THEN 'Degree' WHEN contains(lower(text), 'b.tech') THEN 'B.tech' WHEN contains(lower(text), 'b.s.') THEN 'B.s.'
    WHEN contains(lower(text), 'm.tech') THEN 'M.tech' WHEN contains(lower(text), 'mba') THEN 'Mba' END AS education FROM s)
""" + _unpivot("d", {n: (n, "deterministic", c) for n, c in (("email", .6), ("phone", .6), ("years", .6), ("summary", .7), ("skills", .5), ("organization", .6), ("title", .6), ("education", .5))}))
def extract_deterministic(spark, sf):
    out = e.deterministic_extract(tx.all_texts(spark, sf))
    # trailing line ends are blanks to one engine's trim and not to the other's
    return out.withColumn("value", F.trim("value"))


def _lit(word: str) -> str:
    return "".join("\\" + c if c in "+#/." else c for c in word)


DICT_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN regexp_extract(text, '(?i){_lit(w)}') END" for w in e.SKILL_WORDS) + ")"


@query("extract_dictionary_skills", "E14", T + f" SELECT doc_id, channel, {DICT_SQL} AS skills FROM all_texts")
def extract_dictionary_skills(spark, sf):
    return tx.all_texts(spark, sf).select("doc_id", "channel", F.array_join(e.dictionary_skills(F.col("text")), "|").alias("skills"))


CP = [r"\+[0-9]{1,3}[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}", r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", "[0-9]{10,}"]
CP_SQL = "coalesce(" + ", ".join(f"CASE WHEN length(regexp_replace({_rx(q, 0)}, '[^0-9+]', '', 'g')) >= 10 THEN {_rx(q, 0)} END" for q in CP) + ")"
CY = [r"([0-9]+\.?[0-9]*)\s*(?:\+)?\s*years?\s+(?:of\s+)?experience", r"experience\s+of\s+([0-9]+\.?[0-9]*)\s*(?:\+)?\s*years?",
      r"([0-9]+\.?[0-9]*)\s*(?:\+)?\s*yrs?\s+(?:of\s+)?(?:exp|experience)"]


@query("extract_with_confidence", "E13", T + f""", h AS (SELECT *, list_transform(string_split(text, chr(10)), lambda l: trim(l)) AS ls FROM all_texts),
d AS (SELECT doc_id, channel, {_rx(e.EMAIL, 0)} AS email, greatest(0, len(regexp_extract_all(text, '{e.EMAIL}')) - 1) AS alt, {CP_SQL} AS phone,
  list_filter(ls[1:10], lambda l: l <> '' AND len({WL.format('l')}) <= 4 AND {CAP.format('l')} AND NOT regexp_matches(l, '[@+:|]'))[1] AS name,
  coalesce({', '.join(_rx(y, 1, 'lower(text)') for y in CY)})::DOUBLE || ' years' AS years, nullif({DICT_SQL}, '') AS skills FROM h),
o AS (SELECT *, round((CASE WHEN email IS NULL THEN 0 ELSE 0.95::DOUBLE END + CASE WHEN phone IS NULL THEN 0 ELSE 0.9::DOUBLE END + CASE WHEN name IS NULL THEN 0 ELSE 0.7::DOUBLE END
  + CASE WHEN years IS NULL THEN 0 ELSE 0.85::DOUBLE END + CASE WHEN skills IS NULL THEN 0 ELSE 0.8::DOUBLE END) / 5, 6) AS overall FROM d)
""" + " UNION ALL ".join(f"SELECT doc_id, channel, overall, '{f}' AS field, {c} AS value, CASE WHEN {c} IS NULL THEN 0 ELSE {w} END::DOUBLE AS confidence, {a} AS alternatives FROM o"
                         for f, c, w, a in (("email", "email", .95, "alt"), ("phone", "phone", .9, 0), ("name", "name", .7, 0), ("experience", "years", .85, 0), ("skills", "skills", .8, 0))))
def extract_with_confidence(spark, sf):
    return e.extract_with_confidence(tx.all_texts(spark, sf))


# --- sections: the oracle walks lines with a window, the operator stays inside the row

TAIL = r"(?: details|(?::| -| \|)\s*(?:\S+(?:\s\S+)?)?)?$"
HEAD_CASE = "CASE " + " ".join(f"WHEN regexp_matches(clean, '^(?:{'|'.join(a)}){TAIL}') THEN '{s}'" for s, a in e.SECTION_ALIASES.items()) + " END"
SECTION_SQL = T + f""", ln AS (SELECT doc_id, channel, rtrim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM all_texts),
cl AS (SELECT *, regexp_replace(trim(regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), ':+$', '')), '^[^a-z0-9]+', '') AS clean FROM ln),
hd AS (SELECT *, {HEAD_CASE} AS head FROM cl),
sg AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id, channel ORDER BY i), 'header') AS section FROM hd),
sections AS (SELECT doc_id, channel, section, trim(string_agg(line, chr(10) ORDER BY i), chr(10) || ' ' || chr(9) || chr(13)) AS content FROM sg WHERE head IS NULL GROUP BY ALL HAVING content <> '')"""


@query("extract_sections", "W11", SECTION_SQL + " SELECT * FROM sections")
def extract_sections(spark, sf):
    return e.segment_sections(tx.all_texts(spark, sf))


@query("extract_section_items", "E7 E24", SECTION_SQL + f""",
it AS (SELECT doc_id, channel, section, unnest(x) AS item, generate_subscripts(x, 1) AS i FROM (SELECT *, list_transform(CASE section
  WHEN 'skills' THEN regexp_split_to_array(content, '[,;|/\\n]') WHEN 'certifications' THEN string_split(content, chr(10)) ELSE
  list_filter([{', '.join(f"CASE WHEN regexp_matches(content, '(?i)(^|[^A-Za-z0-9_]){n}([^A-Za-z0-9_]|$)') THEN '{n}' END" for n in e.LANGUAGES)}], lambda y: y IS NOT NULL) END,
  lambda y: trim(regexp_replace(y, '^[-*•]\\s*', ''))) AS x FROM sections WHERE section IN ('skills', 'certifications', 'languages'))),
dd AS (SELECT * FROM it WHERE item <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, channel, section, lower(item) ORDER BY i) = 1)
SELECT doc_id, channel, section, row_number() OVER (PARTITION BY doc_id, channel, section ORDER BY i) - 1 AS position, item FROM dd""")
def extract_section_items(spark, sf):
    return e.section_items(e.segment_sections(tx.all_texts(spark, sf))).withColumn("position", F.col("position").cast("long"))


def _dates(index: int, column: str = "text") -> str:
    d = e.DASH
    shapes = [
        rf"(?i)([0-9]{{1,2}}/[0-9]{{4}})\s*{d}\s*([0-9]{{1,2}}/[0-9]{{4}}|Present|Current)", rf"(?i)([A-Za-z0-9_]+\s+[0-9]{{4}})\s*{d}\s*([A-Za-z0-9_]+\s+[0-9]{{4}}|Present|Current)",
        rf"(?i)([0-9]{{4}})\s*{d}\s*([0-9]{{4}}|Present|Current)",
    ]
    return "coalesce(" + ", ".join(_rx(s, index, column) for s in shapes) + ")"


WS = "chr(10) || ' ' || chr(9) || chr(13)"
JOBS_SQL = SECTION_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
jp AS MATERIALIZED (SELECT doc_id, channel, list_filter(regexp_split_to_array(content, '{e.JOB_BOUNDARY}'), lambda x: trim(x) <> '') AS ps FROM sections WHERE section = 'experience'),
jf AS (SELECT doc_id, channel, 0 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM jp
  UNION ALL SELECT jf.doc_id, jf.channel, i + 1, CASE WHEN length(cur) > 50 THEN ps[i + 1] ELSE cur || ps[i + 1] END,
    CASE WHEN length(cur) > 50 THEN list_append(done, trim(cur, {WS})) ELSE done END FROM jf JOIN jp ON jp.doc_id = jf.doc_id AND jp.channel = jf.channel WHERE i < len(ps)),
je AS (SELECT jf.doc_id, jf.channel, list_filter(list_append(done, trim(cur, {WS})), lambda x: x <> '') AS es FROM jf JOIN jp ON jp.doc_id = jf.doc_id AND jp.channel = jf.channel WHERE i = len(ps)),
en AS (SELECT doc_id, channel, unnest(es) AS entry, generate_subscripts(es, 1) - 1 AS position FROM je),
l AS (SELECT *, list_transform(list_filter(list_transform(string_split(trim(entry), chr(10))[1:3], lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]{{4}}')),
  lambda x: regexp_replace(x, '\\s*{e.DASH}\\s*$', '')) AS ls, {_rx(r'(?:Position|Title|Role)[:\s]+([^\n]{5,60})', 1, 'entry')} AS t1, {_rx(r'(?m)^([A-Z][^\n]{10,60})$', 1, 'entry')} AS t2 FROM en),
r AS (SELECT doc_id, channel, position, list_filter(ls, lambda x: length(x) BETWEEN 3 AND 99)[1] AS company,
  coalesce(CASE WHEN NOT regexp_matches(t1, '[0-9]{{4}}') THEN t1 END, CASE WHEN NOT regexp_matches(t2, '[0-9]{{4}}') THEN t2 END) AS title,
  {_dates(1, 'entry')} AS start, {_dates(2, 'entry')} AS "end" FROM l)
SELECT * FROM r WHERE company IS NOT NULL OR title IS NOT NULL"""


@query("extract_jobs", "E16 E17 E18", JOBS_SQL)
def extract_jobs(spark, sf):
    return e.extract_jobs(e.segment_sections(tx.all_texts(spark, sf))).withColumn("position", F.col("position").cast("long"))


@query("extract_dates_and_titles", "E17 E18", T + f""", l AS (SELECT doc_id, channel, text, list_transform(list_filter(list_transform(string_split(trim(text), chr(10))[1:3], lambda x: trim(x)),
  lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]{{4}}')), lambda x: regexp_replace(x, '\\s*{e.DASH}\\s*$', '')) AS ls, {_rx(r'(?:Position|Title|Role)[:\s]+([^\n]{5,60})')} AS t1, {_rx(r'(?m)^([A-Z][^\n]{10,60})$')} AS t2 FROM all_texts)
SELECT doc_id, channel, {_dates(1)} AS start, {_dates(2)} AS "end", list_filter(ls, lambda x: length(x) BETWEEN 3 AND 99)[1] AS company,
  coalesce(CASE WHEN NOT regexp_matches(t1, '[0-9]{{4}}') THEN t1 END, CASE WHEN NOT regexp_matches(t2, '[0-9]{{4}}') THEN t2 END) AS title FROM l""")
def extract_dates_and_titles(spark, sf):
    c = F.col("text")
    out = tx.all_texts(spark, sf).select("doc_id", "channel", e.date_range(c).alias("d"), e.company_of(c).alias("company"), e.job_title_of(c).alias("title"))
    return out.select("doc_id", "channel", "d.start", "d.end", "company", "title")


EDU_DEG = "trim(coalesce(" + ", ".join(_rx(x, 1, "entry") for x in e.DEGREES) + "))"


@query("extract_education", "E19 E7", SECTION_SQL + f""",
sp AS (SELECT doc_id, channel, list_filter(list_transform(string_split(regexp_replace(content, '{e.EDUCATION_SPLIT}', chr(1) || '\\1', 'g'), chr(1)),
  lambda x: trim(x, chr(10) || ' ' || chr(9) || chr(13))), lambda x: x <> '') AS es FROM sections WHERE section = 'education'),
en AS (SELECT doc_id, channel, unnest(es) AS entry, generate_subscripts(es, 1) - 1 AS position FROM sp),
r AS (SELECT doc_id, channel, position, {EDU_DEG} AS degree, trim(coalesce({_rx('(?i)(?:in|of)\\s+([A-Z][^\\n,]{5,50})', 1, 'entry')},
  {_rx('(?i)(Computer Science|Engineering|Business Administration|Information Technology)', 1, 'entry')})) AS field,
  list_filter(list_transform(string_split(entry, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10 AND NOT {_any('lower(x)', e.SCHOOL_SKIP)} AND regexp_matches(x, '(?i)University|College|Institute|School'))[1] AS institution,
  {_rx('(?:^|[^A-Za-z0-9_])(19[0-9]{2}|20[0-2][0-9])(?:[^A-Za-z0-9_]|$)', 1, 'entry')} AS year,
  coalesce({_rx('(?i)GPA[:\\s]+([0-9]+\\.?[0-9]*)', 1, 'entry')}, {_rx('([0-9]+\\.?[0-9]+)\\s*/\\s*4\\.0', 1, 'entry')}, {_rx('([0-9]+)%', 1, 'entry')}) AS gpa FROM en)
SELECT * FROM r WHERE degree IS NOT NULL OR institution IS NOT NULL""")
def extract_education(spark, sf):
    return e.extract_education(e.segment_sections(tx.all_texts(spark, sf))).withColumn("position", F.col("position").cast("long"))


NUMBERED_SQL = T + r""", l0 AS (SELECT doc_id, channel, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM all_texts),
l AS (SELECT *, regexp_matches(line, '^\s*[0-9]+\)\s*\S') AS head, regexp_matches(line, '(?i)^(education|certification|qualification|declaration)([^A-Za-z0-9_]|$)') AS stop FROM l0 WHERE line <> ''),
f AS (SELECT doc_id, channel, min(i) FILTER (head) AS first FROM l GROUP BY ALL),
z AS (SELECT l.doc_id, l.channel, min(i) AS stop_i FROM l JOIN f ON f.doc_id = l.doc_id AND f.channel = l.channel WHERE stop AND NOT head AND i > first GROUP BY ALL),
k AS (SELECT l.*, sum(head::INT) OVER (PARTITION BY l.doc_id, l.channel ORDER BY i) - 1 AS position FROM l JOIN f ON f.doc_id = l.doc_id AND f.channel = l.channel AND i >= first
  LEFT JOIN z ON z.doc_id = l.doc_id AND z.channel = l.channel WHERE stop_i IS NULL OR i < stop_i),
m AS (SELECT *, min(CASE WHEN NOT head AND regexp_matches(line, '(?i)^primary\s+responsibilities\s*:?\s*$') THEN i END) OVER (PARTITION BY doc_id, channel, position) AS mark FROM k),
g AS (SELECT doc_id, channel, position, max(CASE WHEN head THEN trim(regexp_extract(line, '^\s*[0-9]+\)\s*(.+)$', 1)) END) AS title,
  coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT head AND (mark IS NULL OR i < mark) AND length(line) > 15), '') AS description,
  coalesce(string_agg(trim(line, ' -•*'), '|' ORDER BY i) FILTER (NOT head AND i > mark), '') AS responsibilities FROM m GROUP BY ALL)
SELECT doc_id, channel, position::BIGINT AS position, trim(regexp_replace(title, '(?i)\(\s*tenure\s+[^)]*\)', '', 'g'), ' ,.;:-') AS name,
  trim(nullif(regexp_extract(title, '(?i)\(\s*tenure\s+([^)]+)\)', 1), ''), ' ,.;:-') AS duration, description, responsibilities FROM g
WHERE trim(regexp_replace(title, '(?i)\(\s*tenure\s+[^)]*\)', '', 'g'), ' ,.;:-') <> ''"""


@query("extract_numbered_projects", "E21 E7", NUMBERED_SQL)
def extract_numbered_projects(spark, sf):
    out = e.numbered_projects(tx.all_texts(spark, sf), "text")
    return out.withColumns({"position": F.col("position").cast("long"), "responsibilities": F.array_join("responsibilities", "|")})


SEGMENT_SQL = T + f""", s AS (SELECT doc_id, channel, list_filter(list_transform(CASE WHEN regexp_matches(text, '(?m)^\\s*[0-9]+\\.\\s+(?:\\*\\*)?.')
  THEN list_transform(string_split(regexp_replace(text, '(?m)^(\\s*[0-9]+\\.\\s+(?:\\*\\*)?.)', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: regexp_split_to_array(x, '(?im)^\\s*education\\b')[1])
  ELSE string_split(regexp_replace(text, '{e.PROJECT_CUE}', chr(1) || '\\1', 'g'), chr(1)) END, lambda x: trim(x, chr(10) || ' ' || chr(9) || chr(13))), lambda x: x <> '') AS xs FROM all_texts)"""


@query("extract_spoken_segments", "E9 E22", SEGMENT_SQL + " SELECT doc_id, channel, generate_subscripts(xs, 1) - 1 AS position, unnest(xs) AS segment FROM s")
def extract_spoken_segments(spark, sf):
    out = tx.all_texts(spark, sf).select("doc_id", "channel", F.posexplode(e.spoken_segments(F.col("text"))).alias("position", "segment"))
    return out.withColumn("position", F.col("position").cast("long"))




def _cues(patterns: list[str], column: str) -> str:
    return "coalesce(" + ", ".join(_rx(x, 1, column) for x in patterns) + ")"


SKILL_LEAD = (
    "^(my\\s+)?(primary|secondary|supporting|key|core)?\\s*(skills|skill|technology|technologies|tools|tool|platforms|platform|frameworks|framework)"
    "\\s*(is|are|includes|include|:)?\\s*"
)
PROJECTS_SQL = SEGMENT_SQL + f""", g AS (SELECT doc_id, channel, generate_subscripts(xs, 1) - 1 AS position, unnest(xs) AS segment FROM s),
n AS (SELECT doc_id, channel, position, trim(regexp_replace({_cues(e.NAME_CUES, 'segment')}, '(?i)^\\s*(?:is|called|named)\\s+', '')) AS name, trim({_cues(e.CLIENT_CUES, 'segment')}) AS client,
  trim({_cues(e.ROLE_CUES, 'segment')}) AS role, coalesce({_rx(e.TECH_CUE, 1, 'segment')}, '') AS tech,
  list_filter(list_transform(string_split(segment, '.'), lambda x: trim(x)), lambda x: regexp_matches(x, '(?i)^(?:I|we)\\s+(?:[A-Za-z]+ed|led|built)([^A-Za-z]|$)') AND length(x) > 10) AS duties FROM g),
c AS (SELECT *, trim(lower(regexp_replace(name, '\\s+', ' ', 'g')), ' .,:;') AS k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(tech, chr(10), ', '), '\\s+and\\s+', ', ', 'gi'), '[;/]+', ', ', 'g'),
  '\\s+(\\||-|&)\\s+', ', ', 'g'), '{SKILL_LEAD}', '', 'i') AS x FROM n)
SELECT doc_id, channel, position, name, client, role, array_to_string(list_transform(list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: y <> ''), lambda y: rtrim(y, '.')), '|') AS technologies,
  array_to_string(duties, '|') AS responsibilities FROM c WHERE length(name) > 3 AND k NOT IN ({', '.join(f"'{x}'" for x in INVALID_PROJECT_NAMES)}) AND NOT starts_with(k, 'worked on ') AND NOT starts_with(k, 'responsibilities')"""


@query("extract_spoken_projects", "E8 E23", PROJECTS_SQL)
def extract_spoken_projects(spark, sf):
    out = e.spoken_projects(tx.all_texts(spark, sf))
    return out.withColumns({
        "position": F.col("position").cast("long"), "technologies": F.array_join("technologies", "|"), "responsibilities": F.array_join("responsibilities", "|"),
    })


@query("extract_spoken_person", "E8 E27", T + ", d AS (SELECT doc_id, channel, " + ", ".join(f"trim({_cues(ps, 'lower(text)')}) AS {f}" for f, ps in e.PERSON_CUES.items())
       + " FROM all_texts) " + _unpivot("d", {f: (f, "cue", .85) for f in e.PERSON_CUES}))
def extract_spoken_person(spark, sf):
    return e.spoken_person(tx.all_texts(spark, sf))


SKILL_UNION = " UNION ALL ".join(f"SELECT doc_id, channel, '{k}' AS kind, trim({_cues(ps, 'text')}) AS x FROM all_texts" for k, ps in e.SKILL_CUES.items())


@query("extract_spoken_skills", "E8 E28", T + f""", k AS ({SKILL_UNION}),
c AS (SELECT doc_id, channel, kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(10), ', '), '\\s+and\\s+', ', ', 'gi'), '[;/]+', ', ', 'g'), '\\s+(\\||-|&)\\s+', ', ', 'g'), '{SKILL_LEAD}', '', 'i') AS x FROM k WHERE x IS NOT NULL),
l AS (SELECT *, list_transform(list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: y <> ''), lambda y: rtrim(y, '.')) AS xs FROM c)
SELECT doc_id, channel, kind, generate_subscripts(xs, 1) - 1 AS position, unnest(xs) AS skill FROM l""")
def extract_spoken_skills(spark, sf):
    return e.spoken_skills(tx.all_texts(spark, sf)).withColumn("position", F.col("position").cast("long"))


@query("extract_spoken_employment", "E8 E29", T + f""", d AS (SELECT doc_id, channel, try_cast({_cues(e.EMPLOYMENT_CUES['years_with_employer'], 'text')} AS INT) AS years_with_employer,
  list_filter(list_transform(string_split(regexp_replace({_cues(e.EMPLOYMENT_CUES['clients'], 'text')}, '\\s+and\\s+', ', ', 'gi'), ','), lambda y: trim(y)), lambda y: y <> '') AS c FROM all_texts)
SELECT doc_id, channel, years_with_employer, array_to_string(c, '|') AS clients FROM d WHERE years_with_employer IS NOT NULL OR len(c) > 0""")
def extract_spoken_employment(spark, sf):
    return e.spoken_employment(tx.all_texts(spark, sf)).withColumn("clients", F.array_join("clients", "|"))


SPOKEN_YEAR = "coalesce(" + ", ".join(
    f"CASE WHEN try_cast({x} AS INT) BETWEEN 1950 AND 2030 THEN {x} END" for x in (
        _rx(rf"([0-9]{{4}})\s*{e.DASH}\s*([0-9]{{4}})", 2, "entry"), _rx(r"([0-9]{4})\s+to\s+([0-9]{4})", 2, "entry"),
        _rx(r"(?:^|[^A-Za-z0-9_])(19[0-9]{2}|20[0-2][0-9])(?:[^A-Za-z0-9_]|$)", 1, "entry"))) + ")"


@query("extract_spoken_education", "E8 E20", T + f""", a AS (SELECT doc_id, channel, regexp_extract(text, '(?is)(?:educational background|education)(.*)$', 1) AS part FROM all_texts),
b AS (SELECT doc_id, channel, list_filter(string_split(regexp_replace(part, '(?i)(Then |Next, )', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x) <> '') AS es FROM a),
c AS (SELECT doc_id, channel, unnest(es) AS entry, generate_subscripts(es, 1) - 1 AS position FROM b),
d AS (SELECT doc_id, channel, position, trim({_cues(e.EDUCATION_CUES['degree'], 'entry')}) AS degree, trim({_cues(e.EDUCATION_CUES['field'], 'entry')}) AS field,
  trim({_cues(e.EDUCATION_CUES['institution'], 'entry')}) AS school, {SPOKEN_YEAR} AS year, trim({_cues(e.EDUCATION_CUES['gpa'], 'entry')}) AS gpa FROM c),
r AS (SELECT doc_id, channel, position, degree, field, CASE WHEN length(school) >= 4 AND NOT regexp_matches(school, '{e.BAD_SCHOOL}') THEN school END AS institution, year, gpa FROM d)
SELECT * FROM r WHERE degree IS NOT NULL OR institution IS NOT NULL""")
def extract_spoken_education(spark, sf):
    return e.spoken_education(tx.all_texts(spark, sf)).withColumn("position", F.col("position").cast("long"))


# --- choosing and scoring


@query("extract_best_parse", "A24 E10", P + """, s AS (SELECT cv_id, len(projects) AS n, list_sum(list_transform(projects, lambda p: CASE WHEN p.name <> '' THEN 5 ELSE 0 END + CASE WHEN p.description <> '' THEN 3 ELSE 0 END
  + len(p.responsibilities) + least(5, len(p.technologies)))) AS a, list_sum(list_transform(education, lambda x: CASE WHEN x.degree <> '' THEN 4 ELSE 0 END + CASE WHEN x.institution <> '' THEN 3 ELSE -2 END
  + CASE WHEN x.year <> '' THEN 2 ELSE 0 END)) AS b, list_sum(list_transform(list_filter(projects, lambda p: p.client <> ''), lambda p: 8 + len(p.responsibilities))) AS c FROM profiles)
SELECT cv_id, coalesce(a, 0)::BIGINT AS project_points, coalesce(b, 0)::BIGINT AS education_points FROM s""")
def extract_best_parse(spark, sf):
    df = p.profiles(spark, sf)
    thin = F.filter("projects", lambda x: x["client"] != "")
    # the thin parse comes first for even ids and second for odd ones, so either can win
    even = F.col("cv_id") % 2 == 0
    best = e.best_of(F.when(even, thin).otherwise(F.col("projects")), F.when(even, F.col("projects")).otherwise(thin), e.projects_richness)
    return df.select("cv_id", e.projects_richness(best).cast("long").alias("project_points"), e.education_richness(F.col("education")).cast("long").alias("education_points"))


@query("extract_document_confidence", "E11 T6", P + """, c AS (
  SELECT cv_id, 'full_name' AS path, 0.95::DOUBLE AS confidence FROM profiles WHERE full_name <> '' UNION ALL SELECT cv_id, 'title', 0.9 FROM profiles WHERE title <> ''
  UNION ALL SELECT cv_id, 'email', 0.95 FROM profiles WHERE email <> '' UNION ALL SELECT cv_id, 'phone', 0.9 FROM profiles WHERE phone <> '' UNION ALL SELECT cv_id, 'summary', 0.85 FROM profiles WHERE summary <> ''
  UNION ALL SELECT cv_id, 'primary_skills', CASE WHEN len(primary_skills) > 0 THEN least(0.9, 0.7 + len(primary_skills) * 0.05) ELSE 0.3 END FROM profiles
  UNION ALL SELECT cv_id, 'work', CASE WHEN len(work) > 0 THEN least(0.95, 0.6 + len(work) * 0.08) ELSE 0.2 END FROM profiles
  UNION ALL SELECT cv_id, 'projects', CASE WHEN len(projects) > 0 THEN least(0.95, 0.5 + len(projects) * 0.1) ELSE 0.2 END FROM profiles
  UNION ALL SELECT cv_id, 'education', CASE WHEN len(education) > 0 THEN least(0.9, 0.6 + len(education) * 0.1) ELSE 0.2 END FROM profiles)
SELECT cv_id, path, round(confidence, 6) AS confidence FROM c""")
def extract_document_confidence(spark, sf):
    df = p.profiles(spark, sf)
    return df.select("cv_id", F.explode(e.document_confidence(df)).alias("c")).select("cv_id", "c.*")


@query("extract_field_assessment", "E12 E15", P + """, f AS (SELECT cv_id, 'header.email' AS path, email AS value FROM profiles UNION ALL SELECT cv_id, 'header.contact_number', phone FROM profiles UNION ALL SELECT cv_id, 'header.full_name', full_name FROM profiles),
b AS (SELECT *, CASE WHEN value = '' THEN 0.3 WHEN path = 'header.email' THEN CASE WHEN contains(value, '@') AND contains(value, '.') THEN 0.95 ELSE 0.4 END
  WHEN path = 'header.contact_number' AND regexp_matches(replace(replace(value, ' ', ''), '-', ''), '^[0-9]+$') THEN 0.92 ELSE 0.75 END::DOUBLE AS c FROM f)
SELECT cv_id, path, CASE WHEN value = '' THEN 'unknown' ELSE value END AS value, CASE WHEN value = '' THEN 0.6::DOUBLE ELSE c END AS confidence, c AS assessed FROM b""")
def extract_field_assessment(spark, sf):
    df = p.profiles(spark, sf)
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), F.col(c).alias("value")) for n, c in
                      (("header.email", "email"), ("header.contact_number", "phone"), ("header.full_name", "full_name"))])
    rows = df.select("cv_id", F.explode(pairs).alias("f")).select("cv_id", "f.*")
    rows = rows.withColumn("assessed", e.field_assessment(F.col("path"), F.col("value")))
    value, confidence = e.with_fallback(F.col("value"), F.lit("unknown"), F.col("assessed"))
    return rows.select("cv_id", "path", value.alias("value"), confidence.alias("confidence"), "assessed")


@query("extract_education_order", "O6", P + """, x AS (SELECT cv_id, unnest(education) AS e, generate_subscripts(education, 1) AS i FROM profiles),
r AS (SELECT *, CASE WHEN contains(lower(e.degree), 'phd') THEN 0 WHEN regexp_matches(lower(e.degree), 'mba|ms') THEN 1 WHEN regexp_matches(lower(e.degree), 'bachelor|be') THEN 2 ELSE 3 END AS k,
  coalesce(try_cast(nullif(regexp_extract(e.year, '(19[0-9]{2}|20[0-3][0-9])', 1), '') AS INT), 0) AS y FROM x)
SELECT cv_id, string_agg(e.degree || ':' || e.year, '|' ORDER BY k, y DESC, i) AS ordered FROM r GROUP BY 1""")
def extract_education_order(spark, sf):
    df = p.profiles(spark, sf).where("size(education) > 0").select("cv_id", e.sort_education(F.col("education")).alias("x"))
    return df.select("cv_id", F.expr("array_join(transform(x, e -> concat_ws(':', e.degree, e.year)), '|')").alias("ordered"))
