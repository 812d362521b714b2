"""Deterministic views over the driver's tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIERS = ("exceptional", "strong", "fair", "limited")

ARTICLES = """
select doc_id as id, trim(split_part(text, chr(10), 1)) as title,
 case when doc_id % 17 = 0 then null
      when doc_id % 3 = 0 then concat('The Journal of ', source)
      when doc_id % 3 = 1 then concat('JOURNAL OF ', upper(source))
      else concat('Journal of ', source, ' & Letters') end as journal,
 2016 + doc_id % 10 as published_year,
 case doc_id % 11 when 0 then 'exceptional' when 1 then ' Excellent' when 2 then 'A*' when 3 then 'strong'
   when 4 then 'good' when 5 then 'Fair' when 6 then 'c' when 7 then 'limited' when 8 then 'POOR'
   when 9 then 'others' end as rank_raw,
 case when (doc_id * 7) % 10 < 7 then 'train' when (doc_id * 7) % 10 < 9 then 'validate' end as split,
 upper(lang) as subject,
 case when doc_id % 5 < 3 then 'study' when doc_id % 5 = 3 then 'review' else 'others' end as type,
 case when doc_id % 19 = 0 then 'entries_failed' else 'entries_parsed' end as status,
 case when doc_id % 13 = 0 then '  ' else text end as rq_with_context
from documents"""


def _score(k: int, tier: str) -> str:
    return f"case when (d.doc_id + {k} + m.m) % 9 = 0 then null else -cast((d.doc_id * 7 + {13 * k} + m.m * 29) % 50 as double) / 10 end as lp_{tier}"


OUTCOMES = f"""
select d.doc_id as id, upper(d.lang) as subject, concat('model_', m.m) as model,
 case d.doc_id % 11 when 0 then 'exceptional' when 1 then 'exceptional' when 2 then 'exceptional'
   when 3 then 'strong' when 4 then 'strong' when 5 then 'fair' when 6 then 'fair'
   when 7 then 'limited' when 8 then 'limited' end as truth,
 case when (d.doc_id + m.m) % 7 = 0 then
   case d.doc_id % 4 when 0 then 'Exceptional' when 1 then 'strong' when 2 then 'Fair ' else 'unsure' end end as prediction,
 case (d.doc_id + m.m) % 6 when 0 then '**Strong**' when 1 then 'fair.'
   when 2 then concat('<think>a b</think>', chr(10), 'Limited')
   when 3 then '<final>Exceptional</final>' when 4 then 'cannot decide' end as response_text,
 {", ".join(_score(k, t) for k, t in enumerate(TIERS))}
from documents d cross join (values (0), (1), (2)) as m(m)"""

VOTES = """
select d.doc_id as id, concat('model_', m.m) as model, j.j as slot,
 case (d.doc_id * (j.j + 1) + m.m * 3 + j.j) % 6 when 0 then 'exceptional' when 1 then 'strong'
   when 2 then 'fair' when 3 then 'limited' when 4 then 'alignment_fail' end as vote
from documents d cross join (values (0), (1), (2)) as m(m)
cross join (values (1), (2), (3), (4), (5), (6), (7), (8)) as j(j)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ARTICLES)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OUTCOMES)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VOTES)


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions before it."""
    ctes = [f"{name} as ({text})" for name, text in (("articles", ARTICLES), ("outcomes", OUTCOMES), ("votes", VOTES)) if name in sql]
    sql = sql.strip()
    if not ctes:
        return sql
    start = next((s for s in ("with recursive ", "with ") if sql.lower().startswith(s)), "")
    return f"{start or 'with '}{', '.join(ctes)}{', ' if start else ' '}{sql[len(start):]}"
