"""The operators' inputs, taken from the test tables.

The SQL below is read by both engines, so that a query and its SQL counterpart can't differ in their
inputs. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.operators.store import TalentStore, skill_bridge
from vitaeflow.schema import TABLES

_MONTH = "replace(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7), '-', '.')"
VIEWS = {
    "candidates": """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, n_name AS city,
      CASE c_custkey % 7 WHEN 0 THEN 'high_school' WHEN 1 THEN 'Associate' WHEN 2 THEN 'Bachelor' WHEN 3 THEN 'Master of Science'
        WHEN 4 THEN 'PhD' WHEN 5 THEN NULL ELSE '本科' END AS education_level, c_mktsegment AS source_file
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "experiences": f"""SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS candidate_id, o_orderpriority AS company, o_orderstatus AS title,
      {_MONTH} AS start_date, CASE WHEN o_orderkey % 36 = 0 THEN NULL ELSE CAST(o_orderkey % 36 AS BIGINT) END AS duration_months FROM {{orders}}""",
    "educations": f"""SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS candidate_id, o_orderpriority AS school, o_orderstatus AS degree,
      {_MONTH} AS start_date FROM {{orders}} WHERE o_orderkey % 4 = 0""",
    "mentions": """SELECT CAST(o_custkey AS BIGINT) AS candidate_id, p_name AS name, p_type AS category, l_returnflag AS level, CAST(l_quantity AS BIGINT) AS years,
      l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "job_intentions": """SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS candidate_id, c_mktsegment AS position,
      CAST(floor(abs(c_acctbal)) AS BIGINT) AS salary_min, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 2 * CAST(floor(abs(c_acctbal)) AS BIGINT) END AS salary_max
      FROM {customer} WHERE c_custkey % 5 <> 0""",
    "certifications": "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey AS BIGINT) AS candidate_id, s_name AS name FROM {supplier}",
    "raw_dates": """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 8
        WHEN 0 THEN concat(y, '.', lpad(m, 2, '0')) WHEN 1 THEN concat(y, '.', m) WHEN 2 THEN concat(y, '年') WHEN 3 THEN concat(y, '年', m, '月')
        WHEN 4 THEN concat(' ', y, '/', m) WHEN 5 THEN concat(mon, ' ', y) WHEN 6 THEN concat(y, '-', m) ELSE 'Present ' END AS value
      FROM (SELECT o_orderkey, substr(d, 1, 4) AS y, CAST(CAST(substr(d, 6, 2) AS INT) AS STRING) AS m,
        CASE substr(d, 6, 2) WHEN '01' THEN 'January' WHEN '02' THEN 'Feb' WHEN '03' THEN 'march' WHEN '07' THEN 'Jul' WHEN '09' THEN 'Sept' ELSE 'dec' END AS mon
        FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders}) AS a) AS b""",
    "filenames": """SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 5
        WHEN 0 THEN concat('【', lower(c_mktsegment), '_', n_name, ' ', CAST(c_custkey % 20 + 5 AS STRING), '-', CAST(c_custkey % 20 + 9 AS STRING), 'K】', c_name, ' ', CAST(c_custkey % 9 + 1 AS STRING), '年.pdf')
        WHEN 1 THEN concat('[', lower(c_mktsegment), '_', n_name, ' 20K]', c_name, '.docx')
        WHEN 2 THEN concat('in/【', lower(c_mktsegment), '_', n_name, '】', c_name, ' 3年')
        WHEN 3 THEN concat('【【2026秋招】', lower(c_mktsegment), '_', n_name, ' 15-16K】', c_name, ' 26年应届生.pdf')
        ELSE concat(c_name, '.pdf') END AS file FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "jd_texts": """SELECT CAST(p_partkey AS BIGINT) AS jd_id, concat('We need ', p_name, CASE p_partkey % 6
        WHEN 0 THEN ' with Python, docker and MySQL, 3+ years, Bachelor, in Beijing, 20k-35K' WHEN 1 THEN ' knowing Java or JavaScript. 5 years of work. Master degree; Shanghai 15000-25000'
        WHEN 2 THEN ' PhD in SQL, REST and Go. remote. 10 yr' WHEN 3 THEN '. MBA, linux, 2019-2023, ba' WHEN 4 THEN ' college diploma, kafka, 2 year, 150K ~ 200k' ELSE '' END) AS text FROM {part}""",
    "spans": """SELECT CAST(user_id AS BIGINT) AS doc_key, CAST(event_id AS BIGINT) AS ord, event_type AS type, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 AS STRING) ELSE '' END AS name,
      CAST(user_id * 7 + event_id % 211 AS BIGINT) AS start, CAST(user_id * 7 + event_id % 211 + CAST(floor(abs(value)) AS BIGINT) % 60 AS BIGINT) AS "end",
      CAST(event_id % 5 AS BIGINT) AS n_attrs, CAST(event_id % 17 AS BIGINT) AS text_length, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence FROM {events}""",
    "blocks": """SELECT CAST(l_orderkey % 500 AS BIGINT) AS doc_key, CAST(l_suppkey % 3 AS BIGINT) AS page, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_partkey AS DOUBLE) AS y0,
      CAST(l_partkey % 600 + 100 AS DOUBLE) AS x1, CAST(l_partkey + 10 AS DOUBLE) AS y1, concat(' p', CAST(l_partkey AS STRING), ' ') AS text,
      CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS kind, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 700 ELSE 2000 END AS DOUBLE) AS width
      FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM {lineitem}) AS x""",
}


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the test tables as a DataFrame; columns and filters reach the scans."""
    sql = VIEWS[name].replace('"end"', "`end`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders", "lineitem", "part", "supplier", "events") if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions from documents: (doc_key, ord, text, source); some lines have their spaces doubled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc_key"), F.col("text").alias("source"))
    lines = docs.select("doc_key", "source", F.posexplode(F.split("source", "\n")).alias("ord", "line"))
    return lines.select("doc_key", F.col("ord").cast("long").alias("ord"), line_said(F.col("line"), F.col("ord")).alias("text"), "source")


def line_said(line: Column, order: Column) -> Column:
    """The text of the extraction made of a line."""
    return F.when(order % 3 == 1, F.replace(line, F.lit(" "), F.lit("  "))).when(order % 3 == 2, F.concat(F.lit("~"), line)).otherwise(line)


DOC_LINES_SQL = r"""
lines AS (SELECT CAST(doc_id AS BIGINT) AS doc_key, text AS source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
doc_lines AS (SELECT doc_key, CAST(ord AS BIGINT) AS ord, source,
  CASE ord % 3 WHEN 1 THEN replace(line, ' ', '  ') WHEN 2 THEN '~' || line ELSE line END AS text FROM lines)"""


def store(spark: SparkSession, sf_dir: str) -> TalentStore:
    """The store made of the test tables."""

    def table(name: str) -> DataFrame:
        have = binding(spark, sf_dir, name)
        kinds = dict(c.split() for c in TABLES[name].split(", "))
        return have.select(*((F.col(c) if c in have.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    mentions = binding(spark, sf_dir, "mentions")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    skills = parts.groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("category")).agg(F.min("p_partkey").cast("long").alias("id")).select("id", "name", "category")
    empty = spark.createDataFrame([], TABLES["self_evaluations"])
    return TalentStore(
        candidates=table("candidates"), experiences=table("experiences"), educations=table("educations"), skills=skills,
        candidate_skills=skill_bridge(mentions, skills, MENTION_ORDER), job_intentions=table("job_intentions"), self_evaluations=empty, certifications=table("certifications"),
    )


MENTION_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "years", "level"]
_SKILLS = """skills AS (SELECT min(CAST(p_partkey AS BIGINT)) AS id, p_name AS name, p_type AS category FROM part GROUP BY 2, 3)"""
_BRIDGE = f"""candidate_skills AS (SELECT candidate_id, skill_id, level, years FROM (SELECT m.*, s.id AS skill_id,
  row_number() OVER (PARTITION BY candidate_id, s.id ORDER BY {', '.join(MENTION_ORDER)}) AS k FROM mentions m JOIN skills s USING (name, category)) WHERE k = 1)"""


def ctes(*names: str) -> str:
    """WITH and the named views for the other engine."""
    out = []
    for name in names:
        if name in VIEWS:
            sql = VIEWS[name]
            for t in ("customer", "nation", "orders", "lineitem", "part", "supplier", "events"):
                sql = sql.replace("{" + t + "}", t)
            out.append(f"{name} AS ({sql})")
        else:
            out.append({"skills": _SKILLS, "candidate_skills": _BRIDGE, "doc_lines": DOC_LINES_SQL}[name])
    return "WITH " + ",\n".join(out) + "\n"

