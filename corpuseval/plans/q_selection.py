"""Linkage, sampling, quotas and pairs (D, F)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpuseval.functions import textkeys as tk
from corpuseval.functions.labels import normalize_rank
from corpuseval.operators import filters as fl
from corpuseval.operators import linkage as lk
from corpuseval.operators import pairs as pr
from corpuseval.operators import quotas as qt
from corpuseval.operators import reshape as rs
from corpuseval.operators import sampling as sm
from corpuseval.plans.fixtures import articles, outcomes, table
from corpuseval.plans.q_text import _JOURNAL_KEY, _TOKENS, rank_sql
from corpuseval.plans.registry import query
from corpuseval.sources import io

_RULES = f"rules as (select k, min(rank) as rank from (select {_JOURNAL_KEY} as k, {rank_sql('rank_raw')} as rank from articles where id % 4 = 0 and journal is not null) where rank is not null group by k)"


def _rules(s, d):
    return articles(s, d).where("id % 4 = 0 and journal is not null").select("journal", normalize_rank("rank_raw").alias("rank")).where("rank is not null")


@query("d1_assign_rank", f"with {_RULES}, a as (select *, {_JOURNAL_KEY} as k from articles) select id, case when type = 'study' then coalesce(r.rank, 'others') else rank_raw end as rank from a left join rules r using (k)")
def _(s, d):
    a = articles(s, d).withColumnRenamed("rank_raw", "rank")
    return lk.assign_rank(a, _rules(s, d), scope=F.col("type") == "study").select("id", "rank")


@query("d2_audit_rules", f"with {_RULES}, v as (select journal, count(*) as n, any_value({_JOURNAL_KEY}) as k from articles where trim(journal) <> '' group by journal) select journal, n, k as key, r.rank, r.rank is not null as matched from v left join rules r using (k)")
def _(s, d):
    return lk.audit_rules(articles(s, d), _rules(s, d))


@query("d3_attach_parent", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def _(s, d):
    child = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return lk.attach_parent(child, table(s, d, "nation"), "n_nationkey", "n_name", "p").select("c_custkey", F.col("p.n_name").alias("n_name"))


_CASCADE = """
with idx as (select 'title' as kind, title as key, min(id) as hit from articles where title <> '' group by title union all select 'venue', journal, min(id) from articles where journal <> '' group by journal)
select a.id, coalesce(t.hit, v.hit) as hit, case when t.hit is not null then 'title' when v.hit is not null then 'venue' end as matched_by
from articles a left join idx t on t.kind = 'title' and t.key = case when a.id % 2 = 0 then a.title end left join idx v on v.kind = 'venue' and v.key = a.journal"""


@query("d4_lookup_cascade", _CASCADE)
def _(s, d):
    a = articles(s, d)
    probes = [("title", F.when(F.col("id") % 2 == 0, F.col("title"))), ("venue", F.col("journal"))]
    return lk.lookup_cascade(a, a.withColumn("hit", F.col("id")), "id", probes, [("title", F.col("title")), ("venue", F.col("journal"))], "hit", "id")


_FILES = "select doc_id as id, upper(lang) as subject, 'store/' || lang || '/' || source || '-' || doc_id % 40 || case when doc_id % 3 = 0 then '.PDF' else '.pdf' end as path, lang from documents"
#: Five probes of a row: names of other rows' files, in its own subject or another's, and stems.
_PROBES = {
    "article.path": ("name", "case when id % 5 = 0 then '/a/b/' || split_part(path, '/', 3) end"),
    "row.path": ("name", "case when id % 7 = 0 then 'x/' || source_of || '-' || (id + 20) % 60 || '.pdf' end"),
    "row.name": ("name", "case when id % 3 = 0 then ' ' || upper(source_of) || '-' || (id + 40) % 80 || '.PDF' end"),
    "article.base": ("stem", "case when id % 2 = 0 then source_of || ' - ' || (id + 20) % 80 end"),
    "row.base": ("stem", "source_of || '-' || id % 80"),
}
_ASKING = f"select f.id, case when f.id % 4 = 0 then null else ' ' || lower(f.subject) end as subject, path, split_part(split_part(path, '/', 3), '-', 1) as source_of from ({_FILES}) f"
_KEY = "lower(replace(trim({t}), ' ', ''))"


def _probe_sql() -> str:
    asks = []
    for place, (source, (kind, text)) in enumerate(_PROBES.items()):
        key = _KEY.format(t=f"string_split({text}, '/')[-1]")
        asks.append(f"select id, {2 * place} as prio, 'subject_{kind}' as kind, upper(trim(subject)) || ':' || {key} as key, '{source}:subject' as source from asking union all select id, {2 * place + 1}, '{kind}', {key}, '{source}' from asking")
    index = " union all ".join(f"select '{kind}' as kind, {key} as key, path from named union all select 'subject_{kind}', subject || ':' || {key}, path from named" for kind, key in (("name", _KEY.format(t="name")), ("stem", _KEY.format(t="regexp_replace(name, '\\.[^.]*$', '')"))))
    return f"""with files as ({_FILES}), named as (select path, subject, split_part(path, '/', 3) as name from files), asking as ({_ASKING}),
idx as (select kind, key, min(path) as path from ({index}) group by kind, key), asks as ({" union all ".join(asks)}),
hits as (select a.id, arg_min(i.path, prio) as path, arg_min(source, prio) as matched_by from asks a join idx i using (kind, key) group by a.id)
select a.id, h.path, h.matched_by from asking a left join hits h using (id)"""


@query("d5_match_file", _probe_sql())
def _(s, d):
    docs = table(s, d, "documents")
    files = s.sql(_FILES.replace("from documents", "from {documents}"), documents=docs)
    catalog = files.select("path", tk.identifier_key(tk.path_name("path"), True).alias("name_key"), tk.identifier_key(tk.path_stem("path"), True).alias("stem_key"), "subject")
    asking = s.sql(_ASKING.replace("from documents", "from {documents}"), documents=docs)
    probes = [(source, kind, F.expr(text)) for source, (kind, text) in _PROBES.items()]
    return lk.match_file(asking, io.file_index(catalog), "id", F.col("subject"), probes)


@query("d6_deref", "select o_orderkey, case when length(c_name) > 0 then 'ok' else 'failed' end as link_status from orders left join customer on c_custkey = o_custkey and c_custkey % 3 <> 0")
def _(s, d):
    return lk.deref(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_custkey % 3 <> 0"), "o_custkey", "c_custkey", "c_name").select("o_orderkey", "link_status")


@query("d7_errors_by_group", "select coalesce(nullif(trim(a.journal), ''), 'unmatched') as venue, count(*)::bigint as wrong from outcomes o left join articles a using (id) where o.truth is not null and lower(trim(o.prediction)) <> o.truth group by 1")
def _(s, d):
    wrong = outcomes(s, d).where(F.lower(F.trim("prediction")) != F.col("truth")).select("id")
    venues = lk.first_per_key(articles(s, d).select("id", "journal"), ["id"], F.col("journal").desc())
    return wrong.join(venues, "id", "left").groupBy(F.coalesce(F.nullif(F.trim("journal"), F.lit("")), F.lit("unmatched")).alias("venue")).agg(F.count("*").alias("wrong"))


@query("d8_split_cached", "select id, prediction is not null as cached from outcomes where model = 'model_1'")
def _(s, d):
    o = outcomes(s, d).where("model = 'model_1'")
    cached, pending = lk.split_cached(o.select("id"), o.where("prediction is not null"), "id")
    return cached.withColumn("cached", F.lit(True)).unionByName(pending.withColumn("cached", F.lit(False)))


_ITEMS = f"items as (select id as key, {rank_sql('rank_raw')} as tier from articles)"
_DRAWN = f"""{_ITEMS}, n as (select key, tier, row_number() over (partition by tier order by key) - 1 as at from items where tier is not null), sz as (select tier, count(*) as m from n group by tier),
lv as (select unnest(['exceptional', 'strong', 'fair', 'limited']) as tier, unnest([0, 1, 2, 3]) as lvl),
ty as (select la.tier || '_' || lb.tier as pair_type, la.tier as a, lb.tier as b, sa.m * sb.m as p, sb.m as mb from lv la join lv lb on lb.lvl < la.lvl join sz sa on sa.tier = la.tier join sz sb on sb.tier = lb.tier),
nums as (select distinct pair_type, a, b, mb, case when p > 264 then cast('0x' || substr(md5('32:' || pair_type || ':' || j), 1, 15) as bigint) % p else j end as number from ty cross join (select unnest(range(264)) as j) where p > 264 or j < p),
top as (select * from (select *, row_number() over (partition by pair_type order by md5('32:' || pair_type || ':' || number), number) as nth from nums) where nth <= 50),
drawn as (select pair_type, x.key as key_a, y.key as key_b from top join n x on x.tier = a and x.at = number // mb join n y on y.tier = b and y.at = number % mb)"""


def _pairs(s, d):
    return pr.sample_pairs(articles(s, d).select("id", normalize_rank("rank_raw").alias("tier")), 50, 32, "id", "tier")


@query("d9_tier_pairs", f"with {_DRAWN} select pair_type, count(*)::bigint as n from drawn group by pair_type")
def _(s, d):
    return _pairs(s, d).groupBy("pair_type").agg(F.count("*").alias("n"))


@query("f14_sample_pairs", f"with {_DRAWN} select * from drawn")
def _(s, d):
    return _pairs(s, d)


@query("f15_assign_position", f"with {_DRAWN} select key_a, key_b, case when substr(md5('33:' || key_a || ':' || key_b), 1, 1) < '8' then 'second' else 'first' end as correct_position from drawn")
def _(s, d):
    return pr.assign_position(_pairs(s, d), 32).select("key_a", "key_b", "correct_position")


_TITLE_TOKENS = "list_filter(list_distinct(string_split_regex(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]', ' ', 'g'), '\\s+')), lambda x: x <> '')"
_FUZZY = f"""fz_sets as (select id, {_TITLE_TOKENS} as ts from articles), fz_tokens as (select id, len(ts) as n, unnest(ts) as token from fz_sets),
fz_pairs as (select a.id as l, b.id as r, 2.0 * count(*) / (any_value(a.n) + any_value(b.n)) as f1 from fz_tokens a join fz_tokens b using (token) group by a.id, b.id),
fz as (select l, r, f1 from fz_pairs where f1 >= 0.5)"""


def _fuzzy(s, d):
    a = articles(s, d).select("id", "title")
    return lk.title_classes(a, a, "id", "id", "title", "title", 0.5)


@query("d10_fuzzy_candidates", f"with {_FUZZY} select l, r, round(f1, 6) as f1 from fz")
def _(s, d):
    classes = _fuzzy(s, d)
    return lk.title_pairs(replace(classes, links=classes.links.withColumn("f1", F.round("f1", 6))))


@query("d12_update_by_ids", "select id, case when id in (select id from articles where id % 10 = 3) then 'test' else split end as split from articles")
def _(s, d):
    a = articles(s, d)
    return fl.update_by_ids(a.select("id", "split"), a.where("id % 10 = 3").select("id"), "id", split="test")


@query("d13_in_reference_list", "select id from articles where journal in (select journal from articles where id % 50 = 1)")
def _(s, d):
    a = articles(s, d)
    return lk.in_reference_list(a, a.where("id % 50 = 1"), "journal").select("id")


@query("f1_number_rows", "select id, row_number() over (order by subject, id) as row_no from articles")
def _(s, d):
    return rs.number_rows(articles(s, d).select("id", "subject"), "subject", "id").select("id", F.col("row_no").cast("long").alias("row_no"))


_TOP = "select {cols} from (select *, row_number() over (partition by {by} order by {order}) as nth from {src}) where nth <= {n}"


@query("f2_balance_random", _TOP.format(cols="id, subject", by="subject", order="md5('32:' || id), id", src="articles", n=30))
def _(s, d):
    return sm.balance_random(articles(s, d), ["subject"], 30, 32, "id").select("id", "subject")


@query("f2_balance_embeddings", _TOP.format(cols="vec_id, label", by="label", order="md5('7:' || vec_id), vec_id", src="embeddings", n=10))
def _(s, d):
    return sm.balance_random(table(s, d, "embeddings").select("vec_id", "label"), ["label"], 10, 7, "vec_id")


@query("f3_balance_recent", _TOP.format(cols="id, subject, published_year", by="subject", order="published_year desc, id", src="articles", n=30))
def _(s, d):
    return sm.balance_recent(articles(s, d), ["subject"], 30, "published_year", "id").select("id", "subject", "published_year")


@query("f4_seeded_shuffle", "select id, row_number() over (order by md5('5:' || id), id) as at from articles where split = 'validate'")
def _(s, d):
    rows = articles(s, d).where("split = 'validate'").withColumn("draw", sm.draw(5, "id"))
    return rs.number_rows(sm.seeded_shuffle(rows, 5, "id"), "draw", "id").select("id", F.col("row_no").cast("long").alias("at"))


@query("f5_mark_fraction", "select id, case when split = 'train' and row_number() over (partition by coalesce(split = 'train', false) order by md5('9:' || id), id) <= floor(count(*) over (partition by coalesce(split = 'train', false)) * 0.5) then 'abandon' else split end as split from articles")
def _(s, d):
    return sm.mark_fraction(articles(s, d), F.col("split") == "train", 0.5, "split", "abandon", 9, "id").select("id", "split")


@query("f6_top_up_split", """
with w as (select id, subject, split, count(*) filter (where split = 'validate') over (partition by subject) as have, coalesce(split = 'validate', false) as is_v,
 row_number() over (partition by subject, coalesce(split = 'validate', false) order by md5('3:' || id), id) as place from articles)
select id, case when is_v or place <= 10 - have then 'validate' else 'train' end as split from w""")
def _(s, d):
    return sm.top_up_split(articles(s, d), ["subject"], 10, 3, "id").select("id", "split")


_QUOTA = """
c as (select journal, count(*) as n from articles where journal is not null group by journal),
w as (select *, pow(n::double / sum(n) over (), 0.9) as w from c), r as (select *, 300 * w / sum(w) over () as raw from w),
q as (select *, least(greatest(round_even(raw, 0)::bigint, 0), n) as quota from r), t as (select *, sum(quota) over () as s, row_number() over (partition by quota < n order by raw desc, journal) as up, row_number() over (partition by quota > 0 order by quota - raw desc, journal) as down from q),
vq as (select journal, n, (quota + case when s < 300 and quota < n and up <= 300 - s then 1 when s > 303 and quota > 0 and down <= s - 300 then -1 else 0 end)::bigint as quota from t)"""


def _venue_counts(s, d):
    return articles(s, d).where("journal is not null").groupBy("journal").agg(F.count("*").alias("n"))


@query("f7_venue_quota", f"with {_QUOTA} select journal, n, quota from vq")
def _(s, d):
    return qt.venue_quota(_venue_counts(s, d), 300)


def _year_counts(s, d):
    return articles(s, d).groupBy(F.col("subject").alias("journal"), F.col("published_year").cast("int").alias("year")).agg(F.count("*").alias("n"))


_YEARS = "y as (select subject as journal, published_year::int as year, count(*) as n from articles group by 1, 2)"
_DECAY = f"""
with recursive {_YEARS}, cur as (select journal, least(coalesce(sum(n) filter (where year = 2025), 0), 60)::bigint as first from y group by journal),
o as (select y.journal, year, n, row_number() over (partition by y.journal order by year desc) as i, first from y join cur on y.journal = cur.journal where year <> 2025),
at1 as (select c.journal, any_value(c.first) + coalesce(sum(least(floor(o.first * 1.0)::bigint, o.n)), 0) as total from cur c left join o on c.journal = o.journal group by c.journal),
step as (select journal, 0 as k, 0.5::double as lo, 1.0::double as hi, 1.0::double as best, false as done from cur
 union all
 select s.journal, s.k + 1, case when not s.done and e.t < 60 then (s.lo + s.hi) / 2 else s.lo end, case when not s.done and e.t >= 60 then (s.lo + s.hi) / 2 else s.hi end, case when s.done then s.best else (s.lo + s.hi) / 2 end, s.done or abs(e.t - 60) <= 1
 from step s join lateral (select coalesce(sum(least(floor(o.first * pow((s.lo + s.hi) / 2, o.i))::bigint, o.n)), 0) + max(c.first) as t from cur c left join o on o.journal = c.journal where c.journal = s.journal) e on true where s.k < 50),
dd as (select step.journal, case when at1.total <= 60 then 1.0 else best end as d from step join at1 on at1.journal = step.journal where k = 50)
select o.journal, o.year::bigint as year, least(floor(o.first * pow(dd.d, o.i))::bigint, o.n)::bigint as quota from o join dd on dd.journal = o.journal
union all select journal, 2025, first from cur where first > 0"""


@query("f8_year_quota_decay", _DECAY)
def _(s, d):
    return qt.year_quota_decay(_year_counts(s, d), 60, 2025)


@query("f9_year_quota_weight", f"""
with {_YEARS}, w as (select *, pow(0.8, 2025 - year) as w from y), q as (select *, least(floor(100 * w / sum(w) over (partition by journal))::bigint, n) as quota from w),
r as (select *, greatest(100 - sum(quota) over (partition by journal), 0) as rest, coalesce(sum(n - quota) over (partition by journal order by year desc rows between unbounded preceding and 1 preceding), 0) as before from q)
select journal, year, n, (quota + least(n - quota, greatest(0, rest - before)))::bigint as quota from r""")
def _(s, d):
    return qt.year_quota_weight(_year_counts(s, d), 100, 2025, 0.8)


@query("f10_size_factor", """
with recursive c as (select count(*) as n from articles where journal is not null group by journal), w as (select sum(n)::double as total from c),
step as (select 0 as k, 0.0::double as lo, 4.0::double as hi, 4.0::double as best, false as done
 union all
 select s.k + 1, case when not s.done and e.t > 200 then (s.lo + s.hi) / 2 else s.lo end, case when not s.done and e.t <= 200 then (s.lo + s.hi) / 2 else s.hi end, case when s.done then s.best else (s.lo + s.hi) / 2 end, s.done or abs(e.t - 200) <= 5
 from step s join lateral (select sum(least(n, greatest(1, floor(200 * pow(n / total, (s.lo + s.hi) / 2))::bigint))) as t from c, w) e on true where s.k < 50)
select best as factor, (select sum(least(n, greatest(1, floor(200 * pow(n / total, best))::bigint))) from c, w)::bigint as total from step where k = 50""")
def _(s, d):
    return qt.size_factor(_venue_counts(s, d), 200, 5)


@query("f11_sample_by_quota", f"with {_QUOTA} select id, journal from (select a.id, a.journal, vq.quota, row_number() over (partition by a.journal order by md5('11:' || a.id), a.id) as nth from articles a join vq on a.journal = vq.journal) where nth <= quota")
def _(s, d):
    return sm.sample_by_quota(articles(s, d), qt.venue_quota(_venue_counts(s, d), 300), ["journal"], 11, "id").select("id", "journal")


@query("f12_cap_sample", "select id from articles order by md5('12:' || id), id limit 77")
def _(s, d):
    return sm.cap_sample(articles(s, d), 77, 12, "id").select("id")


@query("f13_mark_kept", "select id, case when subject = 'EN' then id % 3 <> 0 end as abort from articles")
def _(s, d):
    a = articles(s, d).withColumn("abort", F.lit(None).cast("boolean"))
    return sm.mark_kept(a, a.where("id % 3 = 0"), "id", F.col("subject") == "EN").select("id", "abort")


@query("f16_best_candidate", "select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey, max(o_totalprice) as o_totalprice from orders group by o_custkey")
def _(s, d):
    return sm.best_candidate(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("f17_sorts", "select subject, published_year, id, row_number() over (order by subject desc, published_year, id) as at from articles")
def _(s, d):
    a = articles(s, d).select("subject", "published_year", "id")
    return rs.number_rows(a, F.desc("subject"), "published_year", "id").select("subject", "published_year", "id", F.col("row_no").cast("long").alias("at"))


@query("f18_limit", "select id, published_year from articles order by published_year desc, id limit 10")
def _(s, d):
    return rs.select_order(articles(s, d).select("id", "published_year"), ["published_year", "id"], 10, [False, True])


@query("d11_assign_one_to_one", f"""
with recursive {_FUZZY}, ask as materialized (select l, r, f1 from fz where l <> r), th as (select unnest([0.8, 0.7, 0.6, 0.5]) as t),
steps as materialized (select row_number() over (order by t desc, l) as k, t, l, row_number() over (partition by t order by l) = 1 as opens from (select distinct l from ask) cross join th),
go as (select 0::bigint as k, []::struct(l bigint, r bigint, f1 double)[] as held, false as closed
 union all
 select st.k, case when g.closed or (st.opens and len(g.held) >= 120) or e.b is null or list_contains(list_transform(g.held, lambda x: x.l), st.l) then g.held else list_append(g.held, e.b) end, g.closed or (st.opens and len(g.held) >= 120)
 from go g join steps st on st.k = g.k + 1
 left join lateral (select arg_max({{'l': a.l, 'r': a.r, 'f1': a.f1}}, (a.f1, -a.r)) as b from ask a where a.l = st.l and a.f1 >= st.t and not list_contains(list_transform(g.held, lambda x: x.r), a.r)) e on true)
select h.l, h.r, round(h.f1, 6) as f1 from (select unnest(held) as h from go where k = (select max(k) from steps))""")
def _(s, d):
    done = lk.assign_titles(_fuzzy(s, d), [0.8, 0.7, 0.6, 0.5], 120, distinct=True)
    return done.withColumn("f1", F.round("f1", 6))
