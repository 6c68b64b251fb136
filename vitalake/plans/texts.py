"""Transcript and resume texts: one per customer, built row by row from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalake.plans import views as v

# The expressions below are valid in Spark and in DuckDB.
_FACTS = """c_custkey AS doc_id,
  CASE c_custkey % 5 WHEN 0 THEN 'John' WHEN 1 THEN 'Priya' WHEN 2 THEN 'Maria' WHEN 3 THEN 'Chen' ELSE 'Lars' END AS first_name,
  CASE c_custkey % 7 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Sharma' WHEN 2 THEN 'Lopez' WHEN 3 THEN 'Wei' WHEN 4 THEN 'Berg' WHEN 5 THEN 'Okafor' ELSE 'Novak' END AS last_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Austin' ELSE 'Oslo' END AS city,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail' WHEN 'MACHINERY' THEN 'Manufacturing' WHEN 'FURNITURE' THEN 'Banking'
    WHEN 'BUILDING' THEN 'Insurance' ELSE 'Automotive' END AS domain,
  1 + c_custkey % 30 AS years, c_custkey % 6 AS v"""

_TRANSCRIPT = """concat('My name is ', first_name, ' ', last_name, '. My portal id is P', doc_id, '. ', CASE WHEN v = 0 THEN 'thank you. ' ELSE '' END,
  CASE WHEN v % 2 = 0 THEN concat('My email is ', lower(first_name), '.', lower(last_name), ' at example dot com. ')
    ELSE concat('My email is ', lower(first_name), doc_id, '@mail.example.com. ') END,
  'My phone number is +1-555-', 100 + doc_id % 900, '-', 1000 + doc_id % 9000, '. I am located in ', city, ', Texas, USA. I currently work at ',
  domain, ' Systems as a Senior Engineer. I have ', years, ' years of experience',
  CASE WHEN v = 3 THEN ' and 14 months of experience' ELSE '' END,
  '. My primary skills include Python, Java and SQL. My secondary skills are Docker / AWS; ReactJS. Databases are MySQL and Oracle. ',
  'Operating systems are Linux and Windows. AI frameworks are TensorFlow, LangChain and PyTorch. ',
  'I have been working with organization for the past ', 1 + v, ' years with clients such as Acme, Globex and Initech. ',
  'I worked in ', lower(domain), ' and healthcare domain. ',
  CASE WHEN v < 4 THEN 'My first project is called Payment Gateway. The client is Acme. My role was Tech Lead. Technologies used are Java, Spring. I designed the settlement flow and reduced cost by 40%. ' ELSE '' END,
  CASE WHEN v < 2 THEN 'My second project is called Skills. I worked on alerts for 3 years. ' ELSE '' END,
  CASE WHEN v = 5 THEN 'over the course of my career i did many things. ' ELSE '' END,
  'Coming to my educational background, I completed Bachelor of Science in Physics from ', city, ' State University in ', 1990 + doc_id % 30,
  ' with ', 60 + v, '%. ', CASE WHEN v = 5 THEN 'Then Master of Computer Applications from Delta College, 1999 to 2001, GPA: 3.6.' ELSE '' END)"""

_N = "', chr(10), '"
_RESUME = f"""concat(first_name, ' ', last_name, '{_N}Senior Software Engineer{_N}Email: ', lower(first_name), doc_id, '@mail.example.com | Phone: +91 98765 ',
  10000 + doc_id % 90000, '{_N}Location: ', city, ', TX, USA{_N}linkedin.com/in/', lower(first_name), '-', doc_id, '{_N}github.com/', lower(last_name), doc_id,
  '{_N}Employee ID: E', doc_id, ' current grade: G', v, '{_N}Professional Summary{_N}Engineer with ', years, '+ years of experience in ', domain,
  '. Skills: Python, Java/SQL and Go.{_N}Technical Skills:{_N}Python, Java; SQL | Docker{_N}', CASE WHEN v = 2 THEN '• Kubernetes' ELSE 'Kubernetes' END,
  '{_N}Work Experience{_N}Acme Payments Corporation Limited{_N}Title: Lead Engineer for Payments{_N}Jan 2015 - Present{_N}Built the settlement flow for many clients and reduced cost.',
  '{_N}Globex Manufacturing Company Limited{_N}Position: Engineer{_N}03/2010 - 12/2014{_N}Ran the plant data platform for three regions.',
  '{_N}Education{_N}Bachelor of Science in Physics, ', city, ' University, ', 1990 + doc_id % 30, ', GPA: 3.', v, '{_N}MBA in Finance, Delta College, 2009, 78%',
  '{_N}Certifications{_N}AWS Certified Architect{_N}- Scrum Master{_N}Projects{_N}1) Payment Gateway (tenure 2 years){_N}Gateway for card payments across regions{_N}',
  'Primary responsibilities{_N}- Led the team of six engineers{_N}Project: Settlement Hub for cards{_N}2) Fraud Monitor (tenure ', 10 + v, ' months){_N}Monitoring of card fraud in real time',
  '{_N}Languages{_N}English, German and Hindi')""".replace(", '')", ")")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = v.load_spread(spark, sf_dir, "customer", "c_custkey").selectExpr(*_split(_FACTS))
    return facts.select("doc_id", F.lit("transcript").alias("channel"), F.expr(_TRANSCRIPT).alias("text"), "years", "first_name")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = v.load_spread(spark, sf_dir, "customer", "c_custkey").selectExpr(*_split(_FACTS))
    return facts.select("doc_id", F.lit("resume").alias("channel"), F.expr(_RESUME).alias("text"), "years", "first_name")


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts, resumes and documents as (doc_id, channel, text)."""
    docs = v.load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", F.lit("document").alias("channel"), "text")
    cols = ["doc_id", "channel", "text"]
    return transcripts(spark, sf_dir).select(cols).unionByName(resumes(spark, sf_dir).select(cols)).unionByName(docs)


def _split(exprs: str) -> list[str]:
    """Comma-separated select list at depth zero."""
    out, depth, quote, start = [], 0, False, 0
    for i, ch in enumerate(exprs):
        if ch == "'":
            quote = not quote
        elif not quote:
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and depth == 0:
                out.append(exprs[start:i].strip())
                start = i + 1
    return [*out, exprs[start:].strip()]


TEXTS = f"""facts AS (SELECT {_FACTS} FROM customer),
transcripts AS (SELECT doc_id, 'transcript' AS channel, {_TRANSCRIPT} AS text, years, first_name FROM facts),
resumes AS (SELECT doc_id, 'resume' AS channel, {_RESUME} AS text, years, first_name FROM facts),
all_texts AS (SELECT doc_id, channel, text FROM transcripts UNION ALL SELECT doc_id, channel, text FROM resumes
  UNION ALL SELECT doc_id, 'document', text FROM documents)"""
