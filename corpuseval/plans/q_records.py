"""Sources, sinks, filters and reshaping (A, B, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.operators import filters as fl
from corpuseval.operators import reshape as rs
from corpuseval.plans.fixtures import articles, outcomes, table
from corpuseval.plans.registry import query
from corpuseval.sources import io
from corpuseval.sources.shared import scratch


@query("a1_read_jsonl", "select doc_id, lang, source, n_chars from documents")
def _(s, d):
    io.write_jsonl(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), p := scratch(s, "a1"))
    return io.read_jsonl(s, p, "doc_id long, lang string, source string, n_chars long")


@query("a2_read_collection", "select doc_id, lang from documents where lang = 'en' and n_chars > 1000")
def _(s, d):
    return io.read_collection(s, f"{d}/documents.parquet", (F.col("lang") == "en") & (F.col("n_chars") > 1000)).select("doc_id", "lang")


@query("a3_read_jsonl_strict", "select conv_id, turn, role from conversations")
def _(s, d):
    io.write_jsonl(table(s, d, "conversations").select("conv_id", "turn", "role"), p := scratch(s, "a3"))
    return io.read_jsonl(s, p, "conv_id long, turn long, role string", strict=True)


@query("a4_read_json_array", "select item_id, text from benchmark")
def _(s, d):
    rows = table(s, d, "benchmark")
    packed = rows.withColumn("part", F.col("item_id") % 4).groupBy("part").agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "text")))).alias("value"))
    packed.select("value").repartition(4).write.text(p := scratch(s, "a4"))
    return io.read_json_array(s, p, "item_id long, text string").where("item_id is not null")


@query("a5_read_lines", "select distinct trim(source) as name from documents where trim(source) <> ''")
def _(s, d):
    table(s, d, "documents").select(F.concat(F.lit("  "), "source", F.lit(" "))).distinct().write.text(p := scratch(s, "a5"))
    return io.read_lines(s, p, "name")


@query("a6_read_file_catalog", """
with f as (select upper('n_regionkey=' || n_regionkey) as subject from nation group by 1 union all select upper('r_regionkey=' || r_regionkey) from region group by 1)
select 'subject_stem' as kind, subject, true as own from f union all select 'stem', min(subject), true from f group by left(subject, 1)""")
def _(s, d):
    """A folder for each region, written by one task, so that its files share a name: each folder has its own copy, and the first path is that of the name alone."""
    p = scratch(s, "a6")
    for name in ("nation", "region"):
        table(s, d, name).coalesce(1).write.partitionBy(f"{name[0]}_regionkey").json(f"{p}/{name}")
    catalog = io.read_file_catalog(s, p, "*.json")
    found = io.file_index(catalog).where("kind like '%stem'").join(catalog, "path")
    stem = F.element_at(F.split("key", ":"), -1)
    return found.select("kind", "subject", (stem == F.col("stem_key")).alias("own"))


@query("a7_write_jsonl", "select id, title, journal from articles")
def _(s, d):
    io.write_jsonl(articles(s, d).select("id", "title", "journal"), p := scratch(s, "a7"))
    return s.read.schema("id long, title string, journal string").json(p)


@query("a8_write_parquet", "select event_id, event_type, value from events")
def _(s, d):
    io.write_parquet(table(s, d, "events").select("event_id", "event_type", "value"), p := scratch(s, "a8"))
    return s.read.parquet(p)


@query("a9_write_csv", "select lang, printf('%.2f', avg(n_chars)) as mean_chars, count(*)::bigint as n from documents group by lang")
def _(s, d):
    io.write_csv(table(s, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("n")), p := scratch(s, "a9"))
    return s.read.option("header", True).schema("lang string, mean_chars string, n long").csv(p)


@query("a10_report_lines", """
with c as (select subject, type, count(*) as n from articles group by subject, type),
r as (select subject, row_number() over (partition by subject order by type) + 2 as seq, '| ' || type || ' | ' || n || ' |' as line from c)
select subject, seq::bigint as seq, line from r
union all select subject, k, case k when 0 then '## ' || subject when 1 then '| type | n |' else '| --- | --- |' end from (select distinct subject from c) cross join (values (0), (1), (2)) as v(k)""")
def _(s, d):
    counts = articles(s, d).groupBy("subject", "type").agg(F.count("*").alias("n"))
    return io.report_lines(counts, "subject", ["type", "n"], [F.col("type")]).withColumn("seq", F.col("seq").cast("long"))


@query("a11_export_split", "select id, subject, published_year, rank_raw from articles where split = 'train' and type = 'study' and status = 'entries_parsed'")
def _(s, d):
    rows = articles(s, d).where(fl.all_of([fl.Filter("split", "eq", "train"), fl.Filter("type", "eq", "study"), fl.Filter("status", "eq", "entries_parsed")]))
    return rs.select_order(rows, ["subject", "published_year", "id"]).select("id", "subject", "published_year", "rank_raw")


@query("a12_export_subject", "select id, title from articles where subject = 'EN' order by published_year, id limit 50")
def _(s, d):
    return rs.select_order(articles(s, d).where("subject = 'EN'"), ["published_year", "id"], 50).select("id", "title")


@query("a13_export_sidecar", "select id, split, title from articles where split = 'validate'")
def _(s, d):
    rows = articles(s, d).where("split = 'validate'")
    io.write_jsonl(rows.select("id", "title"), p := scratch(s, "a13"))
    io.write_jsonl(rows.select("id", "split"), side := scratch(s, "a13-side"))
    return s.read.schema("id long, split string").json(side).join(s.read.schema("id long, title string").json(p), "id")


_UPSERT = """
with o as (select id, journal as v from articles where id % 2 = 0), n as (select id, case when id % 9 = 0 then null else 'new' end as v from articles where id % 3 = 0)
select coalesce(n.id, o.id) as id, {v} as v from o full join n on o.id = n.id"""


def _halves(s, d):
    a = articles(s, d)
    return a.where("id % 2 = 0").select("id", F.col("journal").alias("v")), a.where("id % 3 = 0").select("id", F.expr("case when id % 9 = 0 then null else 'new' end").alias("v"))


@query("a14_upsert_replace", _UPSERT.format(v="case when n.id is not null then n.v else o.v end"))
def _(s, d):
    old, new = _halves(s, d)
    return io.upsert(old, new, "id")


@query("a14_upsert_patch", _UPSERT.format(v="coalesce(n.v, o.v)"))
def _(s, d):
    old, new = _halves(s, d)
    return io.upsert(old, new, "id", mode="patch")


@query("a15_replace_scope", "select id, subject, split from articles where not coalesce(subject = 'FR' and split = 'validate', false) union all select -id - 1, subject, split from articles where subject = 'FR' and split = 'validate' and id % 2 = 0")
def _(s, d):
    a = articles(s, d).select("id", "subject", "split")
    new = a.where("subject = 'FR' and split = 'validate' and id % 2 = 0").withColumn("id", -F.col("id") - 1)
    return io.replace_scope(a, new, (F.col("subject") == "FR") & (F.col("split") == "validate"), "subject")


@query("a16_copy_with_links", "select o_orderkey, 'copied' as status, o_custkey, c_name from orders left join customer on c_custkey = o_custkey where o_orderstatus = 'F'")
def _(s, d):
    rows, links = io.copy_with_links(table(s, d, "orders"), F.col("o_orderstatus") == "F", table(s, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "copied", order="o_orderkey")
    return rows.join(links, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "status", "o_custkey", "c_name")


@query("a17_last_results", "select user_id, event_type, max(event_id) as event_id from events group by user_id, event_type")
def _(s, d):
    return io.last_results(table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("a20_save_results", "select d.doc_id, d.lang, n from documents d join (select lang, count(*)::bigint as n from documents group by lang) m on m.lang is not distinct from d.lang")
def _(s, d):
    docs = table(s, d, "documents")
    io.save_results(docs.groupBy("lang").agg(F.count("*").alias("n")), docs.select("doc_id", "lang"), p := scratch(s, "a20"))
    metrics = s.read.schema("lang string, n long").json(f"{p}/metrics")
    results = s.read.schema("doc_id long, lang string").json(f"{p}/results")
    return results.alias("r").join(metrics.alias("m"), F.expr("r.lang <=> m.lang")).select("doc_id", "r.lang", "n")


@query("a21_export_by_venues", """
with v as (select distinct lower(replace(journal, 'The ', '')) as k from articles where id % 7 = 0 and journal is not null)
select id, journal, coalesce(split, 'train') as split from articles
where published_year <= 2020 and lower(replace(journal, 'The ', '')) in (select k from v) and regexp_matches(rq_with_context, '\\S')""")
def _(s, d):
    from corpuseval.operators.linkage import in_reference_list

    key = F.lower(F.replace("journal", F.lit("The "), F.lit("")))
    a = articles(s, d).withColumn("k", key)
    rows = a.where((F.col("published_year") <= 2020) & fl.has_text("rq_with_context"))
    return in_reference_list(rows, a.where("id % 7 = 0 and journal is not null"), "k").select("id", "journal", F.coalesce("split", F.lit("train")).alias("split"))


@query("a22_export_selected_models", "select id, model, prediction from outcomes where model in ('model_0', 'model_2') and prediction is not null")
def _(s, d):
    from corpuseval.operators.outcomes import explode_outcomes, fold_outcomes, keep_models

    nested = fold_outcomes(outcomes(s, d).where("prediction is not null"), "id", F.lit("rq"), "model", F.struct("prediction"))
    return explode_outcomes(keep_models(nested, "val_outcome", "rq", ["model_0", "model_2"]), "val_outcome", "rq", "id").select("id", "model", F.col("outcome.prediction").alias("prediction"))


@query("a23_convert_predictions", "select row_number() over (order by id) as row_no, id, 'fixed' as origin from articles where split = 'validate'")
def _(s, d):
    rows = rs.number_rows(articles(s, d).where("split = 'validate'").select("id"), "id")
    return rs.project(rows, {"row_no": F.col("row_no").cast("long"), "id": "id"}, origin="fixed")


@query("a24_metadata_pipeline", "select s_suppkey as supplier_key, s_name as name, n_name as country from supplier left join nation on s_nationkey = n_nationkey")
def _(s, d):
    from corpuseval.operators.linkage import attach_parent

    child = table(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    joined = attach_parent(child, table(s, d, "nation"), "n_nationkey", "n_name", "nation")
    named = rs.rename_fields(joined.select("s_suppkey", "s_name", F.col("nation.n_name").alias("n_name")), {"s_suppkey": "supplier_key"}, {1: "name"}, {"n_name": "country"})
    io.write_jsonl(named, p := scratch(s, "a24"))
    return s.read.schema("supplier_key long, name string, country string").json(p)


for _name, _filter, _where in (
    ("b1_eq", fl.Filter("rank_raw", "eq", "strong"), "rank_raw is not distinct from 'strong'"),
    ("b2_ne", fl.Filter("rank_raw", "ne", "strong"), "rank_raw is distinct from 'strong'"),
    ("b3_in", fl.Filter("rank_raw", "in", ["strong", "Fair", None]), "rank_raw in ('strong', 'Fair') or rank_raw is null"),
    ("b4_nin", fl.Filter("rank_raw", "nin", ["strong", "Fair"]), "rank_raw is null or rank_raw not in ('strong', 'Fair')"),
    ("b5_gt", fl.Filter("published_year", "gt", 2020), "published_year > 2020"),
    ("b6_gte", fl.Filter("published_year", "gte", 2020), "published_year >= 2020"),
    ("b7_lt", fl.Filter("published_year", "lt", 2020), "published_year < 2020"),
    ("b8_lte", fl.Filter("published_year", "lte", 2020), "published_year <= 2020"),
    ("b9_contains", fl.Filter("journal", "contains", "Journal"), "contains(journal, 'Journal')"),
    ("b10_regex", fl.Filter("journal", "regex", "src[0-4]$"), "regexp_matches(journal, 'src[0-4]$')"),
):
    query(_name, f"select id, journal, rank_raw, published_year from articles where {_where}")(lambda s, d, f=_filter: articles(s, d).where(fl.condition(f)).select("id", "journal", "rank_raw", "published_year"))


@query("b9_contains_store", "select id from articles where regexp_matches(journal, '(?i)journal of')")
def _(s, d):
    return articles(s, d).where(fl.condition(fl.Filter("journal", "contains", "journal of"), "store")).select("id")


@query("b11_all_of", "select id from articles where published_year > 2018 and published_year < 2023 and rank_raw is distinct from 'good'")
def _(s, d):
    return articles(s, d).where(fl.all_of([fl.Filter("published_year", "gt", 2018), fl.Filter("published_year", "lt", 2023), fl.Filter("rank_raw", "ne", "good")])).select("id")


@query("b12_corpus_filter", "select id from articles where split = 'train' and subject in ('EN', 'FR') and type in ('study') and published_year = 2018")
def _(s, d):
    f = fl.CorpusFilter(split="train", subject=("EN", "FR"), type=("study",), published_year=(2019,))
    return articles(s, d).where(fl.all_of(f.build([fl.Filter("published_year", "eq", 2018)]))).select("id")


@query("b13_has_text", "select id from articles where regexp_matches(rq_with_context, '\\S')")
def _(s, d):
    return articles(s, d).where(fl.has_text("rq_with_context")).select("id")


@query("b14_boolean_tree", "select id from articles where (split is null or split = 'train') and (journal is not null and journal <> '') and not (type = 'others')")
def _(s, d):
    return articles(s, d).where(fl.missing_or("split", "train") & (F.col("journal").isNotNull() & (F.col("journal") != "")) & ~(F.col("type") == "others")).select("id")


@query("b15_project", "select id as article, coalesce(split, 'train') as split, upper(type) as kind, 'v1' as version from articles")
def _(s, d):
    return rs.project(articles(s, d), {"article": "id", "split": F.coalesce("split", F.lit("train")), "kind": F.upper("type")}, version="v1")


@query("b16_json_safe", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from events")
def _(s, d):
    return rs.json_safe(table(s, d, "events").select("event_id", "ts"))


@query("b17_count", "select count(*)::bigint as n from articles where type = 'study' and journal is distinct from 'x'")
def _(s, d):
    return fl.filtered_count(articles(s, d), fl.all_of([fl.Filter("type", "eq", "study"), fl.Filter("journal", "ne", "x")]))


@query("b18_find_one", "select id, title from articles where subject = 'DE' order by id limit 1")
def _(s, d):
    return fl.find_one(articles(s, d), "subject", "DE", "id").select("id", "title")


@query("b19_paginate", "select id, published_year from articles order by published_year, id limit 20 offset 40")
def _(s, d):
    return fl.paginate(articles(s, d).select("id", "published_year"), 3, 20, "published_year", "id")


@query("b19_page_count", "select count(*)::bigint as total, ceil(count(*) / 30.0)::bigint as total_pages from articles")
def _(s, d):
    return fl.page_count(articles(s, d), 30)


@query("b20_batch_id", "select id, ((row_number() over (order by id)) - 1) // 64 as batch from articles")
def _(s, d):
    return rs.batch_id(articles(s, d).select("id"), 64, "id")


@query("b21_rename_fields", "select doc_id as id, lang as language, source as origin, n_chars from documents")
def _(s, d):
    return rs.rename_fields(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), {"doc_id": "id"}, {1: "language"}, {"source": "origin"})




def _pairs(**cols):
    return F.create_map(*(c for k, v in cols.items() for c in (F.lit(k), v)))


def _flat(df: DataFrame, col: str) -> DataFrame:
    """A map as sorted text, for comparison."""
    return df.withColumn(col, F.array_join(F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ","))


@query("b22_rename_nested_keys", "select id, 'kind=' || type || ',topic=' || subject as m from articles")
def _(s, d):
    a = articles(s, d).select("id", _pairs(subject=F.col("subject"), kind=F.col("type")).alias("m"))
    return _flat(a.withColumn("m", rs.rename_nested_keys("m", {"subject": "topic"})), "m")


@query("b23_drop_null_fields", "select id, concat_ws(',', 'journal=' || journal, 'split=' || split) as m from articles")
def _(s, d):
    a = articles(s, d).select("id", _pairs(journal=F.col("journal"), split=F.col("split")).alias("m"))
    return _flat(a.withColumn("m", rs.drop_null_fields("m")), "m")


@query("b24_nest_dotted", "select doc_id, lang, source from documents")
def _(s, d):
    flat = table(s, d, "documents").select("doc_id", F.col("lang").alias("metadata.lang"), F.col("source").alias("metadata.origin.source"))
    return rs.nest_dotted(flat).select("doc_id", F.col("metadata.lang").alias("lang"), F.col("metadata.origin.source").alias("source"))


@query("b25_merge_missing", "select id, concat_ws(',', 'journal=' || coalesce(journal, 'none'), 'split=' || coalesce(split, 'open')) as m from articles")
def _(s, d):
    a = articles(s, d).select("id", _pairs(journal=F.col("journal"), split=F.coalesce("split", F.lit(""))).alias("t"), _pairs(journal=F.lit("none"), split=F.lit("open")).alias("s"))
    return _flat(a.select("id", rs.merge_missing("t", "s").alias("m")), "m")


@query("b26_map_update", "select id, 'a=' || type || ',b=' || coalesce(journal, 'null') as m from articles")
def _(s, d):
    a = articles(s, d).select("id", _pairs(a=F.col("type"), b=F.lit("old")).alias("l"), _pairs(b=F.col("journal")).alias("r"))
    return _flat(a.select("id", rs.map_update("l", "r").alias("m")), "m")


@query("b27_distinct_values", "select distinct journal from articles where trim(journal) <> ''")
def _(s, d):
    return rs.distinct_values(articles(s, d), "journal")


@query("b29_update_where", "select id, case when split is null then 'abandon' else split end as split from articles")
def _(s, d):
    return fl.update_where(articles(s, d), F.col("split").isNull(), split="abandon").select("id", "split")


@query("b30_repair", "select id, case when journal is distinct from upper(journal) and trim(upper(journal)) <> '' then upper(journal) else journal end as journal, coalesce(journal is distinct from upper(journal) and trim(upper(journal)) <> '', false) as repaired from articles")
def _(s, d):
    return rs.repair_from(articles(s, d), "journal", F.upper("journal")).select("id", "journal", "repaired")


@query("g1_union_all", "select id, 'cached' as origin from articles where id % 2 = 0 union all select id, 'new' from articles where id % 2 = 1")
def _(s, d):
    a = articles(s, d).select("id")
    return a.where("id % 2 = 0").withColumn("origin", F.lit("cached")).unionByName(a.where("id % 2 = 1").withColumn("origin", F.lit("new")))


@query("g2_union_reports", "select lang as name, count(*)::bigint as n from documents group by lang union all select source, count(*) from documents group by source")
def _(s, d):
    docs, p = table(s, d, "documents"), scratch(s, "g2")
    for k, c in enumerate(("lang", "source")):
        docs.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).write.json(f"{p}/r{k}")
    return s.read.schema("name string, n long").json([f"{p}/r0", f"{p}/r1"])


@query("g3_difference", "select distinct journal from articles where type = 'study' and journal is not null except select journal from articles where type = 'review'")
def _(s, d):
    a = articles(s, d)
    return a.where("type = 'study' and journal is not null").select("journal").subtract(a.where("type = 'review'").select("journal"))


@query("g4_array_intersection", "select id, len(list_intersect(list_distinct(string_split(lower(title), ' ')), ['the', 'of', 'and']))::integer as n from articles")
def _(s, d):
    return articles(s, d).select("id", F.size(F.array_intersect(F.split(F.lower("title"), " "), F.array(F.lit("the"), F.lit("of"), F.lit("and")))).alias("n"))


@query("g5_distinct_links", "select distinct o_custkey from orders where o_orderpriority = '1-URGENT'")
def _(s, d):
    return table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
