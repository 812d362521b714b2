"""Profiles, metrics, outcomes, datasets, scoring and status jobs (E, H, I, J, L)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corpuseval.functions import labels as lb
from corpuseval.operators import datasets as ds
from corpuseval.operators import metrics as mt
from corpuseval.operators import outcomes as oc
from corpuseval.operators import pairs as pr
from corpuseval.operators import profile as pf
from corpuseval.operators import scoring as sc
from corpuseval.plans.fixtures import TIERS, articles, outcomes, table, votes
from corpuseval.plans.q_selection import _DRAWN
from corpuseval.plans.q_text import SCORES_SQL, final_sql, label_sql, logp_map, rank_sql
from corpuseval.plans.registry import query
from corpuseval.sources.shared import scratch
from corpuseval.streaming import jobs


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ---- profiles

_TIER = rank_sql("rank_raw")


def _ranked(s, d):
    return articles(s, d).withColumn("tier", lb.normalize_rank("rank_raw"))


@query("e1_crosstab", f"with t as (select subject, {_TIER} as tier from articles) select coalesce(subject, 'TOTAL') as subject, {', '.join(f'''count(*) filter (where tier = '{t}') as {t}''' for t in TIERS)}, count(*) as total, round(100.0 * count(*) / (select count(*) from t), 6) as share from t group by rollup (subject)")
def _(s, d):
    return pf.crosstab_with_totals(_ranked(s, d), "subject", "tier", TIERS).withColumn("share", F.round("share", 6))


@query("e1_crosstab_orders", "select coalesce(o_orderpriority, 'TOTAL') as o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) as total, round(100.0 * count(*) / (select count(*) from orders), 6) as share from orders group by rollup (o_orderpriority)")
def _(s, d):
    return pf.crosstab_with_totals(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O")).withColumn("share", F.round("share", 6))


@query("e2_group_profile", f"select type, {_TIER} as tier, count(*) as n, count(distinct journal) as n_distinct from articles group by 1, 2")
def _(s, d):
    return pf.group_profile(_ranked(s, d), ["type", "tier"], "journal")


@query("e3_venue_rank_counts", f"select {_TIER} as tier, journal, count(*) as n from articles group by 1, 2")
def _(s, d):
    return pf.value_counts(_ranked(s, d), "tier", "journal")


@query("e3_rank_summary", f"with c as (select {_TIER} as tier, journal, count(*) as n from articles group by 1, 2) select tier, count(*) as groups, sum(n)::bigint as total, round(avg(n), 6) as mean from c group by tier")
def _(s, d):
    return pf.per_group_summary(pf.value_counts(_ranked(s, d), "tier", "journal"), "tier").withColumn("mean", F.round("mean", 6))


@query("e4_venue_counts", "select case when grouping(journal) = 1 then 'TOTAL' else journal end as journal, count(*) as n from articles group by rollup (journal)")
def _(s, d):
    return pf.counts_with_total(articles(s, d), "journal")


@query("e5_shares", "select journal, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from articles group by journal")
def _(s, d):
    return pf.shares(articles(s, d), "journal").withColumn("percent", F.round("percent", 6))


@query("e6_top_values", "select journal, count(*) as n from articles where journal is not null group by journal order by n desc, journal limit 20")
def _(s, d):
    return pf.top_values(articles(s, d), "journal")


@query("e7_wrong_rate", "select subject, count(*) filter (where lower(trim(prediction)) <> truth) as wrong, count(*) as total, round(100.0 * count(*) filter (where lower(trim(prediction)) <> truth) / count(*), 6) as percent from outcomes group by subject")
def _(s, d):
    return pf.wrong_rate(outcomes(s, d), "subject", F.lower(F.trim("prediction")) != F.col("truth")).withColumn("percent", F.round("percent", 6))


@query("e8_year_histogram", """
with o as (select coalesce(nullif(published_year, 2020), 2025)::int as year, count(*) as n from articles group by 1), k as (select coalesce(nullif(published_year, 2020), 2025)::int as year, count(*) as n from articles where id % 3 = 0 group by 1),
t as (select coalesce(o.year, k.year) as year, coalesce(o.n, 0) as original, coalesce(o.n // 2, 0) as quota, coalesce(k.n, 0) as kept from o full join k on o.year = k.year)
select year, original, quota, kept, coalesce(kept >= lag(kept) over (order by year), true) as rising from t""")
def _(s, d):
    a = articles(s, d).withColumn("year", F.nullif(F.col("published_year"), F.lit(2020)).cast("int"))
    quota = a.groupBy(F.coalesce("year", F.lit(2025)).alias("year")).agg(F.expr("count(*) div 2").alias("quota"))
    return pf.year_histogram(a, quota, a.where("id % 3 = 0"), "year", 2025)


@query("e9_coverage", f"select count(*) as total, count(*) filter (where split = 'train') as kept, count(*) filter (where journal is null) as no_venue, count(*) filter (where {_TIER} is null) as other_rank from articles")
def _(s, d):
    return pf.coverage_summary(_ranked(s, d), kept=F.col("split") == "train", no_venue=F.col("journal").isNull(), other_rank=F.col("tier").isNull())


# ---- metrics over outcomes

_LABEL = label_sql(final_sql("response_text"))
_BEST = f"{SCORES_SQL}, best as (select id, model, first(label order by logp desc, k) filter (where logp is not null) as p1, list(label order by coalesce(logp, '-infinity'::double) desc, k)[2] as p2 from scores group by id, model)"


@query("e10_accuracy_top", f"with {_BEST} select o.model, round(avg((coalesce(p1 <> '' and contains(truth, p1), false))::int), 6) as accuracy_top1, round(avg((coalesce(contains(truth, p1), false) or coalesce(contains(truth, p2), false))::int), 6) as accuracy_top1_or_top2 from outcomes o join best b on o.id = b.id and o.model = b.model group by o.model")
def _(s, d):
    rows = outcomes(s, d).withColumn("t", lb.logp_top2(logp_map())).select("model", F.initcap("truth").alias("truth"), "t.*")
    return mt.accuracy_top(rows, ["model"], "truth", "top1", "top2").select("model", *r6("accuracy_top1", "accuracy_top1_or_top2"))


_VOTE_LIST = "vl as (select id, model, list(vote order by slot) as vs from votes group by id, model)"


def _vote_lists(s, d):
    return votes(s, d).groupBy("id", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vote"))), lambda x: x["vote"]).alias("votes"))


def _voted(s, d):
    return _vote_lists(s, d).join(outcomes(s, d).select("id", "model", "truth"), ["id", "model"])


@query("e11_e12_accuracy_match", f"with {_VOTE_LIST}, m as (select o.model, coalesce(lower(trim(o.prediction)) = o.truth, false) as hit, len(list_filter(vs, lambda v: v = o.truth)) / 8.0 as a from outcomes o join vl using (id, model)) select model, round(avg(hit::int), 6) as accuracy_text_match, round(avg(a), 6) as accuracy_avg from m group by model")
def _(s, d):
    o = outcomes(s, d).select("id", "model", "truth", (F.lower(F.trim("prediction")) == F.col("truth")).alias("hit"))
    rows = _vote_lists(s, d).join(o, ["id", "model"]).withColumn("a", lb.vote_stats("votes", "truth")["avg_accuracy"])
    return mt.accuracy_match(rows, ["model"], "hit", "a").select("model", *r6("accuracy_text_match", "accuracy_avg"))


@query("e13_mode_select", "select model, case when bool_or(case when model = 'model_0' then lp_fair end is not null) then 'avg' when bool_or(case when model = 'model_1' then lp_fair end is not null) then 'logp' else 'text' end as mode from outcomes group by model")
def _(s, d):
    rows = outcomes(s, d).select("model", F.when(F.col("model") == "model_0", F.col("lp_fair")).alias("a"), F.when(F.col("model") == "model_1", F.col("lp_fair")).alias("t"), F.lit(True).alias("m"))
    return mt.mode_select(rows, ["model"], "a", "t", "m")


_PRF = """prf as (select model, label, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, tp + fn as support from sums),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from prf)"""
_HARD = f"""ev as (select model, truth, lower(trim(prediction)) as p from outcomes where prediction is not null), lab as (select unnest(['exceptional', 'strong', 'fair', 'limited']) as label),
sums as (select model, label, count(*) filter (where coalesce(truth = label, false) and p = label)::double as tp, count(*) filter (where not coalesce(truth = label, false) and p = label)::double as fp, count(*) filter (where coalesce(truth = label, false) and p <> label)::double as fn from ev cross join lab group by 1, 2), {_PRF}"""


def _hard(s, d):
    return mt.label_prf(outcomes(s, d).withColumns({"p": F.trim("prediction"), "truth": F.initcap("truth")}), ["model"], "truth", "p")


@query("e14_label_prf", f"with {_HARD} select model, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from f")
def _(s, d):
    return _hard(s, d).select("model", "label", *r6("precision", "recall", "f1"), "support")


@query("e15_label_prf_soft", f"""
with {_VOTE_LIST}, ev as (select model, truth, list_filter(vs, lambda v: v is not null) as g from vl join outcomes o using (id, model)), lab as (select unnest(['exceptional', 'strong', 'fair', 'limited']) as label),
sh as (select model, label, coalesce(truth = label, false) as t, coalesce(len(list_filter(g, lambda v: v = label))::double / nullif(len(g), 0), 0) as x from ev cross join lab),
sums as (select model, label, sum(case when t then x else 0 end) as tp, sum(case when not t then x else 0 end) as fp, sum(case when t then 1 - x else 0 end) as fn from sh group by 1, 2), {_PRF}
select model, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(support, 6) as support from f""")
def _(s, d):
    return mt.label_prf_soft(_voted(s, d).withColumn("truth", F.upper("truth")), ["model"], "truth", "votes").select("model", "label", *r6("precision", "recall", "f1", "support"))


@query("e16_macro", f"with {_HARD} select model, round(coalesce(avg(recall) filter (where support > 0), 0), 6) as balanced_accuracy, round(coalesce(avg(f1) filter (where support > 0), 0), 6) as macro_f1 from f group by model")
def _(s, d):
    return mt.macro(_hard(s, d), ["model"]).select("model", *r6("balanced_accuracy", "macro_f1"))


@query("e17_confusion_matrix", f"select truth, {', '.join(f'''count(*) filter (where lower(trim(prediction)) = '{t}') as {t}''' for t in TIERS)} from outcomes where truth is not null group by truth")
def _(s, d):
    return mt.confusion_matrix(outcomes(s, d).withColumn("p", F.lower(F.trim("prediction"))), "truth", "p")


_PLAIN = "case when lower(trim(prediction)) in ('exceptional', 'strong', 'fair', 'limited') then lower(trim(prediction)) end"
_RESOLVED = f"""{SCORES_SQL}, ba as (select id, model, first(label order by logp desc, label) filter (where logp is not null) as best from scores group by id, model),
res as (select o.id, o.subject, o.model, o.truth, coalesce({_PLAIN}, {_LABEL}, best) as label, case when {_PLAIN} is not null then 'prediction' when {_LABEL} is not null then 'response_text' when best is not null then 'logp' end as source from outcomes o join ba on o.id = ba.id and o.model = ba.model)"""


def _nested(s, d):
    """Outcomes folded into the map of entries and models, then exploded again."""
    value = F.struct("prediction", "response_text", logp_map().alias("logp"), F.col("truth"))
    return oc.fold_outcomes(outcomes(s, d), "id", F.lit("rq_with_context"), "model", value, "subject")


def _resolved(s, d):
    found = oc.resolve_prediction(F.col("prediction"), F.lit(None).cast("array<string>"), F.col("response_text"), logp_map())
    return outcomes(s, d).select("id", "subject", "model", "truth", found.alias("f")).select("id", "subject", "model", "truth", "f.label", "f.source")


_BOARD = f"""
with {_RESOLVED}, j as (select * from res where truth is not null and label is not null), lab as (select unnest(['exceptional', 'strong', 'fair', 'limited']) as lb),
f as (select subject, model, lb, coalesce(2.0 * count(*) filter (where truth = lb and label = lb) / nullif(count(*) filter (where truth = lb) + count(*) filter (where label = lb), 0), 0) as f1 from j cross join lab group by 1, 2, 3),
m as (select subject, model, 100.0 * sum(f1) / 4 as macro_f1 from f group by 1, 2),
sc as (select subject, model, source, row_number() over (partition by subject, model order by count(*) desc, source) as nth from j group by subject, model, source)
select j.subject, j.model, count(*) as n, round(100.0 * count(*) filter (where truth = label) / count(*), 6) as accuracy, round(any_value(m.macro_f1), 6) as macro_f1, any_value(sc.source) as source
from j join m on m.subject = j.subject and m.model = j.model join sc on sc.subject = j.subject and sc.model = j.model and sc.nth = 1 group by j.subject, j.model"""


@query("e18_leaderboard", _BOARD)
def _(s, d):
    board = mt.leaderboard(_resolved(s, d), "subject", "model", "truth", "label", "source")
    return board.select("subject", "model", "n", *r6("accuracy", "macro_f1"), "source")


@query("e19_dominant_source", "with c as (select lang, source, count(*) as n from documents group by 1, 2) select lang, source from (select *, row_number() over (partition by lang order by n desc, source) as k from c) where k = 1")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.mode("source", True).alias("source"))


_VOTED = """vc as (select id, model, vote, count(*) as n, min(slot) as at from votes where vote in ('exceptional', 'strong', 'fair', 'limited') group by 1, 2, 3),
vm as (select id, model, max(n) as top from vc group by 1, 2), vt as (select vc.id, vc.model, min(vc.vote) as winner, count(*) as k, string_agg(vc.vote, ',' order by vc.vote) as tied from vc join vm on vm.id = vc.id and vm.model = vc.model and vc.n = vm.top group by 1, 2)"""


@query("e20_majority_vote", f"with {_VOTED}, i as (select distinct id, model from votes) select i.id, i.model, winner, coalesce(k > 1, false) as is_tie, case when k > 1 then tied end as tied, vc.at::bigint as pick from i left join vt on vt.id = i.id and vt.model = i.model left join vc on vc.id = i.id and vc.model = i.model and vc.vote = vt.winner")
def _(s, d):
    return _vote_lists(s, d).select("id", "model", lb.majority_vote("votes").alias("v")).select("id", "model", "v.winner", "v.is_tie", F.array_join("v.tied", ",").alias("tied"), F.col("v.pick").cast("long").alias("pick"))


@query("e21_vote_stats", "select v.id, v.model, count(*)::int as n, (count(*) filter (where vote in ('exceptional', 'strong', 'fair', 'limited')))::int as valid_n, round(count(*) filter (where vote = o.truth) / 8.0, 6) as avg_accuracy from votes v join outcomes o on o.id = v.id and o.model = v.model group by 1, 2")
def _(s, d):
    return _voted(s, d).select("id", "model", lb.vote_stats("votes", "truth").alias("v")).select("id", "model", "v.n", "v.valid_n", F.round("v.avg_accuracy", 6).alias("avg_accuracy"))


_PAIRS = "p as (select a.truth || '_' || b.truth as pair_type, case (a.id + b.id) % 3 when 0 then 'first' when 1 then 'second' else '?' end as told, case when (a.id * 3 + b.id) % 2 = 0 then 'first' else 'second' end as correct_position from outcomes a join outcomes b on a.model = 'model_0' and b.model = 'model_0' and b.id = a.id + 1 where a.truth <> b.truth)"


def _judged(s, d):
    a = outcomes(s, d).where("model = 'model_0' and truth is not null").select("id", "truth")
    b = a.select((F.col("id") - 1).alias("id"), F.col("truth").alias("other"))
    p = a.join(b, "id").where("truth <> other")
    total = F.col("id") * 2 + 1
    told = F.when(total % 3 == 0, "first").when(total % 3 == 1, "second").otherwise("?")
    position = F.when((F.col("id") * 4 + 1) % 2 == 0, "first").otherwise("second")
    return pr.judge_pairs(p.select("id", F.concat_ws("_", "truth", "other").alias("pair_type"), told.alias("prediction"), position.alias("correct_position")))


@query("e22_pair_metrics", f"""
with {_PAIRS}, t as (select pair_type, count(*) filter (where told <> '?') as n, count(*) filter (where told = correct_position) as correct, count(*) filter (where told = '?') as failed from p group by 1)
select pair_type, n, correct, failed, round(correct / n, 6) as accuracy, null::double as weighted_accuracy from t where n > 0
union all select 'overall', sum(n)::bigint, sum(correct)::bigint, sum(failed)::bigint, round(coalesce(sum(correct) / nullif(sum(n), 0), 0), 6), round(coalesce(avg(correct / nullif(n, 0)), 0), 6) from t""")
def _(s, d):
    return mt.pair_metrics(_judged(s, d), "pair_type", "is_correct", "alignment_fail").select("pair_type", "n", "correct", "failed", *r6("accuracy", "weighted_accuracy"))


def _choice(messages: list, sample: int) -> str:
    """A stub that answers by a hash of the question: the first, the second, or neither."""
    digit = int(hashlib.md5(messages[-1]["content"].encode()).hexdigest()[0], 16) % 3
    return ("<think>a</think>\nFirst.", "**second**", "both")[digit]


@query("j5_pair_job", f"""
with {_DRAWN}, placed as (select pair_type, key_a, key_b, substr(md5('33:' || key_a || ':' || key_b), 1, 1) < '8' as heads from drawn),
pos as (select pair_type, case when heads then key_a else key_b end as first, case when heads then key_b else key_a end as second, case when heads then 'second' else 'first' end as correct_position from placed),
asked as (select pos.*, x.tier as rank_first, y.tier as rank_second, ('0x' || substr(md5('RQ1: ' || trim(x.title) || chr(10) || chr(10) || 'RQ2: ' || trim(y.title)), 1, 1))::int % 3 as digit
 from pos join (select id, trim(title) as title, {rank_sql('rank_raw')} as tier from articles where trim(title) <> '') x on x.id = first join (select id, trim(title) as title, {rank_sql('rank_raw')} as tier from articles where trim(title) <> '') y on y.id = second),
told as (select *, case digit when 0 then 'first' when 1 then 'second' end as prediction from asked)
select pair_type, first, second, rank_first, rank_second, correct_position, prediction, prediction is null as alignment_fail, coalesce(prediction = correct_position, false) as is_correct from told""")
def _(s, d):
    """Two runs over one cache: the second asks nothing."""
    items = articles(s, d).select("id", "title", lb.normalize_rank("rank_raw").alias("tier"))
    path = scratch(s, "pairs")
    for _ in range(2):
        done = pr.pair_job(items, _choice, "id", "tier", "title", _PROMPT, 50, 32, path)
    return done.select("pair_type", "first", "second", "rank_first", "rank_second", "correct_position", "prediction", "alignment_fail", "is_correct")


@query("e23_build_counters", f"select count(*) as total, count(*) filter (where trim(rq_with_context) <> '' and coalesce(trim(rank_raw), '') <> '') as valid, count(*) filter (where trim(rq_with_context) = '') as skipped_text, count(*) filter (where trim(rq_with_context) <> '' and coalesce(trim(rank_raw), '') = '') as skipped_label from articles")
def _(s, d):
    return ds.build_counters(articles(s, d), "rq_with_context", "rank_raw")


@query("e24_run_counters", "select case when prediction is not null then 'cached' when response_text is not null then 'new' else 'failed' end as outcome, count(*) as n from outcomes group by 1")
def _(s, d):
    return pf.outcome_counts(outcomes(s, d), F.when(F.col("prediction").isNotNull(), "cached").when(F.col("response_text").isNotNull(), "new").otherwise("failed"))


# ---- nested outcomes


@query("h1_explode_outcomes", "select id, model, truth from outcomes")
def _(s, d):
    return oc.explode_outcomes(_nested(s, d), "val_outcome", "rq_with_context", "id").select("id", "model", F.col("outcome.truth").alias("truth"))


@query("h2_get_outcome", "select id, response_text from outcomes where model = 'model_1'")
def _(s, d):
    return _nested(s, d).select("id", oc.get_outcome("val_outcome", "rq_with_context", "model_1")["response_text"].alias("response_text"))


@query("h3_put_outcome", "select id, model, prediction from outcomes where model <> 'model_1' union all select distinct id, 'model_1', 'set' from outcomes union all select distinct id, 'model_9', 'set' from outcomes")
def _(s, d):
    n = oc.fold_outcomes(outcomes(s, d), "id", F.lit("rq"), "model", F.struct(F.col("prediction").alias("prediction")))
    new = F.struct(F.lit("set").alias("prediction"))
    n = n.withColumn("val_outcome", oc.put_outcome("val_outcome", "rq", "model_1", new)).withColumn("val_outcome", oc.put_outcome("val_outcome", "rq", "model_9", new))
    return oc.explode_outcomes(n, "val_outcome", "rq", "id").select("id", "model", "outcome.prediction")


@query("h4_keep_models", "select id, model from outcomes where model in ('model_0', 'model_2')")
def _(s, d):
    kept = oc.keep_models(_nested(s, d), "val_outcome", "rq_with_context", ["model_2", "model_0"])
    return oc.explode_outcomes(kept, "val_outcome", "rq_with_context", "id").select("id", "model")


@query("h5_remove_models", "select id, model from outcomes where model = 'model_2'")
def _(s, d):
    less = _nested(s, d).withColumn("val_outcome", oc.remove_models("val_outcome", ["model_0", "model_1"]))
    return oc.explode_outcomes(less, "val_outcome", "rq_with_context", "id").select("id", "model")


@query("h6_resolve_prediction", f"with {_RESOLVED} select id, model, label, source from res")
def _(s, d):
    return _resolved(s, d).select("id", "model", "label", "source")


@query("h7_outcome_is_valid", "select id, model, prediction is not null or response_text is not null as valid, lp_exceptional is not null or lp_strong is not null or lp_fair is not null or lp_limited is not null as valid_logp from outcomes")
def _(s, d):
    o = outcomes(s, d).select("id", "model", F.struct("prediction", F.lit(None).cast("boolean").alias("is_match"), F.when(F.col("response_text") == "fair.", "").otherwise(F.col("response_text")).alias("response_text"), logp_map().alias("logp"), F.lit(None).cast("array<string>").alias("vote_predictions")).alias("o"))
    return o.select("id", "model", oc.outcome_is_valid(F.col("o"), False).alias("valid"), oc.outcome_is_valid(F.col("o"), True).alias("valid_logp"))


@query("h8_fill_null_votes", "select id, model, string_agg(coalesce(vote, 'strong'), ',' order by slot) as votes from votes group by id, model")
def _(s, d):
    v = votes(s, d)
    filled = oc.fill_null_votes(v, v.where("vote is null").withColumn("vote", F.lit("strong")), ["id", "model"])
    return filled.select("id", "model", F.array_join("vote_predictions", ",").alias("votes"))


# ---- datasets

_PROMPT = "Judge the text."


def _messages(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("i1_to_messages", f"select id, 'Judge the text.' as system, md5(trim(rq_with_context)) as ask, coalesce(upper(substr({_TIER}, 1, 1)) || substr({_TIER}, 2), trim(rank_raw)) as answer from articles")
def _(s, d):
    m = articles(s, d).select("id", ds.to_messages("rq_with_context", "rank_raw", _PROMPT).alias("m"))
    return m.select("id", F.col("m")[0]["content"].alias("system"), F.md5(F.col("m")[1]["content"]).alias("ask"), F.col("m")[2]["content"].alias("answer"))


@query("i2_build_training_set", f"select id from (select id, row_number() over (partition by coalesce(upper(substr({_TIER}, 1, 1)) || substr({_TIER}, 2), trim(rank_raw)) order by md5('32:' || id), id) as nth from articles where trim(rq_with_context) <> '' and trim(rank_raw) <> '') where nth <= 25")
def _(s, d):
    return ds.build_training_set(articles(s, d), "rq_with_context", "rank_raw", _PROMPT, per_class=25, shuffle=True).select("id")


@query("i3_to_prompt_completion", """
with m as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from conversations)
select conv_id, md5(coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn, role, text) filter (where back > 1), '') || '<|assistant|>' || chr(10)) as prompt, max(text) filter (where back = 1) as completion from m group by conv_id""")
def _(s, d):
    return _messages(s, d).select("conv_id", ds.to_prompt_completion("messages").alias("p")).select("conv_id", F.md5("p.prompt").alias("prompt"), "p.completion")


@query("i4_pick_payload", "select text from documents")
def _(s, d):
    return ds.pick_payload(table(s, d, "documents"))


@query("i5_eval_messages", "select id, md5(coalesce(nullif(trim(rq_with_context), ''), nullif(trim(title), ''))) as ask from articles where coalesce(nullif(trim(rq_with_context), ''), nullif(trim(title), '')) is not null")
def _(s, d):
    m = articles(s, d).select("id", ds.eval_messages("rq_with_context", "title", _PROMPT).alias("m")).where("m is not null")
    return m.select("id", F.md5(F.col("m")[1]["content"]).alias("ask"))


@query("i6_pair_messages", "select id, 'RQ1: ' || trim(title) || chr(10) || chr(10) || 'RQ2: ' || trim(type) as ask from articles")
def _(s, d):
    return pr.pair_messages(articles(s, d), _PROMPT, "title", "type").select("id", F.col("messages")[1]["content"].alias("ask"))


@query("i7_prompts", "select id, case type when 'study' then 'Rate the study.' when 'review' then 'Rate the review.' end as prompt from articles")
def _(s, d):
    named = ds.prompts(s, {"study": "Rate the study.", "review": "Rate the review."})
    return ds.with_prompt(articles(s, d).withColumn("prompt_name", F.col("type")), named).select("id", "prompt")


@query("i8_extraction_messages", "select id, 'Return one JSON object with the fields a, b.' as system, title as ask from articles")
def _(s, d):
    m = articles(s, d).select("id", ds.extraction_messages("title", ["a", "b"]).alias("m"))
    return m.select("id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("ask"))


@query("i9_eval_split", "select id from articles where split = 'validate' and trim(rq_with_context) <> '' and trim(rank_raw) <> ''")
def _(s, d):
    return ds.build_training_set(articles(s, d).where("split = 'validate'"), "rq_with_context", "rank_raw", _PROMPT).select("id")


@query("i10_flatten_messages", "select conv_id, md5(coalesce(string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) order by turn, role, text) filter (where trim(text) <> ''), '')) as h from conversations group by conv_id")
def _(s, d):
    return _messages(s, d).select("conv_id", F.md5(ds.flatten_messages("messages")).alias("h"))


@query("i11_split_system", "with g as (select conv_id, coalesce(string_agg(text, chr(10) || chr(10) order by turn, role, text) filter (where role = 'system'), '') as instruction, coalesce(string_agg(text, chr(10) || chr(10) order by turn, role, text) filter (where role in ('user', 'assistant', 'model')), '') as ask from conversations group by conv_id) select conv_id, instruction, case when trim(ask) <> '' then md5(ask) end as input from g")
def _(s, d):
    return _messages(s, d).select("conv_id", ds.split_system("messages").alias("r")).select("conv_id", "r.instruction", F.md5("r.input").alias("input"))


# ---- scoring

_STUB = "['exceptional', 'strong', 'fair', 'limited'][(('0x' || substr(md5(k || ':' || trim(title)), 1, 1))::int % 4) + 1]"


def _asked(s, d):
    return articles(s, d).where("trim(title) <> ''").select("id", lb.normalize_rank("rank_raw").alias("truth"), ds.eval_messages("title", "title", _PROMPT).alias("messages"))


@query("j1_score", f"select id, {_STUB} as response_text, 1 as attempts, null::varchar as error from (select *, '0' as k from articles where trim(title) <> '')")
def _(s, d):
    return sc.score(_asked(s, d), sc.stub_model, ["id"]).select("id", "response_text", "attempts", "error")


@query("j2_sample_n", f"select id, k::int as sample, {_STUB} as response_text from (select *, unnest(['0', '1', '2']) as k from articles where trim(title) <> '')")
def _(s, d):
    return sc.score(sc.sample_n(_asked(s, d), 3), sc.stub_model, ["id", "sample"], sample="sample").select("id", "sample", "response_text")


@query("j3_with_retries", "select id, case when id % 2 = 1 then 'ok' end as response_text, case when id % 2 = 1 then 1 else 3 end as attempts, id % 2 = 0 as failed from articles where trim(title) <> ''")
def _(s, d):
    def model(messages: list, sample: int) -> str:
        if sample == 0:
            raise ValueError("no answer")
        return "ok"

    rows = _asked(s, d).withColumn("odd", (F.col("id") % 2).cast("int"))
    return sc.score(rows, model, ["id"], sample="odd", retries=2, wait=0).select("id", "response_text", "attempts", F.col("error").isNotNull().alias("failed"))


#: Earlier outcomes: every fifth item has one of eight votes, and the next one lacks two of its votes.
_EARLIER = "case when id % 5 = 0 then 'fair' when id % 5 = 1 and k not in ('2', '5') then 'strong' end"
_VALIDATED = f"""v as (select id, {_TIER} as truth, id % 5 = 0 as reused, k, coalesce({_EARLIER}, {_STUB}) as vote from (select *, unnest(['0', '1', '2', '3', '4', '5', '6', '7']) as k from articles where trim(title) <> '')),
c as (select id, truth, vote, count(*) as n from v group by 1, 2, 3), w as (select id, vote, row_number() over (partition by id order by n desc, vote) as nth from c)"""


def _validation(s, d):
    slots = [F.when(F.col("id") % 5 == 0, "fair").when((F.col("id") % 5 == 1) & F.lit(k not in (2, 5)), "strong") for k in range(8)]
    earlier = oc.outcome_struct(response_text=F.lit("earlier"), vote_predictions=F.array(*slots), avg_accuracy=F.when(lb.normalize_rank("truth") == "fair", 1.0).otherwise(0.0))
    asked = _asked(s, d).withColumn("val_outcome", F.when(F.col("id") % 5 < 2, F.create_map(F.lit("title"), F.create_map(F.lit("stub"), earlier))))
    return sc.validate_job(asked, sc.stub_model, "id", "messages", "truth", "stub", "title", refill=True)


@query("j4_validate_job", f"""
with {_VALIDATED} select v.id, reused, any_value(w.vote) as winner, string_agg(v.vote, ',' order by k) as votes, round(count(*) filter (where v.vote = v.truth) / 8.0, 6) as avg_accuracy from v join w on w.id = v.id and nth = 1 group by v.id, reused""")
def _(s, d):
    """Outcomes as they are put back into the items; each has one."""
    done = _validation(s, d)
    o = oc.get_outcome("val_outcome", "title", "stub")
    rows = done.items.join(done.results.select("id", "reused"), "id").select("id", "reused", o.alias("o"))
    return rows.select("id", "reused", lb.majority_vote("o.vote_predictions")["winner"].alias("winner"), F.array_join("o.vote_predictions", ",").alias("votes"), F.round("o.avg_accuracy", 6).alias("avg_accuracy"))


@query("j4_validation_report", f"""
with {_VALIDATED}, lab as (select unnest(['exceptional', 'strong', 'fair', 'limited']) as label), sh as (select id, truth, label, count(*) filter (where vote = label) / 8.0 as x from v cross join lab group by 1, 2, 3),
sums as (select 1 as model, label, sum(case when truth = label then x else 0 end) as tp, sum(case when coalesce(truth = label, false) then 0 else x end) as fp, sum(case when truth = label then 1 - x else 0 end) as fn from sh group by 2), {_PRF},
tall as (select label, unnest(['precision', 'recall', 'f1', 'support']) as metric, unnest([precision, recall, f1, support]) as value from f)
select metric, label, round(value, 6) as value from tall union all select 'balanced_accuracy', null, round(avg(recall) filter (where support > 0), 6) from f union all select 'macro_f1', null, round(avg(f1) filter (where support > 0), 6) from f
union all select 'accuracy_avg', null, round(avg(a), 6) from (select id, count(*) filter (where vote = truth) / 8.0 as a from v group by id)""")
def _(s, d):
    return sc.validation_report(_validation(s, d).results, "truth").select("metric", "label", F.round("value", 6).alias("value"))


def _answers(messages: list, sample: int) -> str:
    """A stub that reads the text it is given: no answer to every fifth length, else JSON of a field, an empty word and a type."""
    text = messages[-1]["content"]
    if len(text) % 5 == 0:
        return "I cannot say."
    kind = ("study", "review", "others")[len(text) % 3]
    return f"Sure: {{core_rq_short: '{len(text)}', gap_focused: 'N/A', type: '{kind}'}}"


_LENGTH = "length(trim(rq_with_context))"


@query("j6_generate_entries", f"""
with t as (select id, rq_with_context as old, id % 4 as trials, trim(rq_with_context) <> '' as has_text, case when trim(rq_with_context) <> '' and {_LENGTH} % 5 <> 0 then {_LENGTH} end as n from articles)
select id, case when n is not null then 'entries_parsed' when has_text and trials < 3 then 'entries_retrying' else 'entries_failed' end as status, case when n is null then trials else 0 end::int as trial_count, n::varchar as core_rq_short, null::varchar as gap_focused, md5(old) as rq_with_context from t""")
def _(s, d):
    a = articles(s, d).withColumn("entries", F.create_map(F.lit("rq_with_context"), F.col("rq_with_context"), F.lit("gap_focused"), F.lit(None).cast("string"))).withColumn("trial_count", (F.col("id") % 4).cast("int"))
    done = sc.generate_entries_job(a, _answers, "id", "rq_with_context", ["core_rq_short", "gap_focused"], _PROMPT, limit=3)
    return done.select("id", "status", "trial_count", *(F.try_element_at("entries", F.lit(k)).alias(k) for k in ("core_rq_short", "gap_focused")), F.md5(F.try_element_at("entries", F.lit("rq_with_context"))).alias("rq_with_context"))


@query("j7_classify_type", """
with t as (select id, length(coalesce(nullif(trim(rq_with_context), ''), nullif(trim(title), ''))) as n from articles)
select id, case when n is null or n % 5 = 0 then 'failed' else ['study', 'review', 'others'][n % 3 + 1] end as type from t""")
def _(s, d):
    return sc.classify_type_job(articles(s, d), _answers, "id", [("abstract", "rq_with_context"), ("title", "title")], _PROMPT).select("id", "type")


@sc.register("usable_articles")
def usable_articles(df):
    """Articles with a venue and a split, by subject."""
    return df.where("journal is not null and split is not null").groupBy("subject", "split").agg(F.count("*").alias("n"))


@query("j8_registry", "select subject, split, count(*) as n from articles where journal is not null and split is not null group by subject, split")
def _(s, d):
    return articles(s, d).transform(sc.TRANSFORMS["usable_articles"])


@query("h9_outcome_struct", "select id, model, prediction, response_text, lp_fair as fair, coalesce(lower(trim(prediction)) = truth, false) as is_match, null::integer as vote_n from outcomes")
def _(s, d):
    match = F.coalesce(F.lower(F.trim("prediction")) == F.col("truth"), F.lit(False))
    o = outcomes(s, d).select("id", "model", oc.outcome_struct(prediction=F.col("prediction"), response_text=F.col("response_text"), logp=logp_map(), is_match=match).alias("o"))
    return o.select("id", "model", "o.prediction", "o.response_text", F.try_element_at("o.logp", F.lit("fair")).alias("fair"), "o.is_match", "o.vote_n")


@query("a18_distill", f"select id as item_id, {_TIER} as ground_truth, {_STUB} as response_text from (select *, '0' as k from articles where trim(title) <> '')")
def _(s, d):
    asked = _asked(s, d)
    return sc.distill_rows(asked, sc.score(asked, sc.stub_model, ["id"]), "id", "truth").select("item_id", "ground_truth", "response_text")


@query("a19_dead_letter", "select id from articles where trim(title) <> '' and id % 5 = 0")
def _(s, d):
    def model(messages: list, sample: int) -> str:
        if sample == 0:
            raise ValueError("no answer")
        return "ok"

    rows = _asked(s, d).withColumn("m", (F.col("id") % 5).cast("int"))
    return sc.dead_letters(sc.score(rows, model, ["id"], sample="m", retries=0))[1].select("id")


# ---- status jobs


def _work(s, d):
    return articles(s, d).select("id", F.lit("created").alias("status"), (F.col("id") % 4).cast("int").alias("trial_count"), "type")


@query("l2_advance_status", "select id, case when id % 3 = 0 then 'pdf_parsed' when id % 4 + 1 < 3 then 'retrying' else 'failed' end as status, case when id % 3 = 0 then 0 else (id % 4 + 1)::int end as trial_count from articles")
def _(s, d):
    return jobs.advance_status(jobs.claim(_work(s, d)), F.col("id") % 3 == 0, "pdf_parsed", "retrying", "failed").select("id", "status", "trial_count")


@query("l3_eligible", "select id from articles where id % 2 = 0 or id % 4 < 3")
def _(s, d):
    rows = _work(s, d).withColumn("status", F.when(F.col("id") % 2 == 0, "created").otherwise("retrying"))
    return jobs.eligible(rows, "created", "retrying").select("id")


@query("l6_stage_chain", "select id, case when id % 5 > 2 then 'content_parsed_failed' else 'entries_parsed' end as status, case when id % 5 > 2 then 3 else 0 end as trial_count, case when id % 5 > 2 then id % 5 - 3 else 0 end::int as fails from articles")
def _(s, d):
    """Three runs of three steps; the second step fails for a row as often as the row says."""
    rows = articles(s, d).select("id", F.lit("created").alias("status"), F.lit(0).alias("trial_count"), (F.col("id") % 5).cast("int").alias("fails"))
    table_path = scratch(s, "stages")
    done = lambda df: df.withColumn("ok", F.lit(True))
    flaky = lambda df: df.withColumn("ok", F.col("fails") == 0).withColumn("fails", F.greatest(F.col("fails") - 1, F.lit(0)))
    stages = [jobs.Stage("created", "pdf_parsed", done), jobs.Stage("pdf_parsed", "content_parsed", flaky), jobs.Stage("content_parsed", "entries_parsed", done)]
    jobs.enqueue(rows, table_path, "id", parts=2)
    for _ in range(3):
        jobs.stage_chain(s, table_path, rows.schema, "id", stages, f"{table_path}-checkpoints", parts=2)
    return jobs.latest(s, table_path, rows.schema)


@query("l1_ingest_stream", "select event_id, event_type from events where event_type <> 'none'")
def _(s, d):
    from corpuseval.sources.io import write_jsonl
    from corpuseval.sources.shared import scratch

    p = scratch(s, "l1")
    write_jsonl(table(s, d, "events").select("event_id", "event_type"), f"{p}/in")
    jobs.ingest_stream(s, f"{p}/in", "event_id long, event_type string", f"{p}/out", f"{p}/checkpoint", lambda df: df.where("event_type <> 'none'"))
    return s.read.schema("event_id long, event_type string").parquet(f"{p}/out")


@query("l4_upsert_stream", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def _(s, d):
    """All events in four micro-batches, later ones merged into what earlier ones have left."""
    from corpuseval.sources.io import write_jsonl
    from corpuseval.sources.shared import scratch

    p, schema = scratch(s, "l4"), "user_id long, event_id long, event_type string"
    write_jsonl(table(s, d, "events").select("user_id", "event_id", "event_type").repartitionByRange(4, "event_id"), f"{p}/in")
    rows = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{p}/in")
    jobs.upsert_stream(rows, f"{p}/table", "user_id", f"{p}/checkpoint", "event_id", parts=8)
    return jobs.latest(s, f"{p}/table", schema)


@query("l5_resume", f"select id, {_STUB} as response_text, 1 as attempts, id % 3 = 0 as earlier from (select *, '0' as k from articles where trim(title) <> '')")
def _(s, d):
    """A run over a third of the rows, of which every other answer is lost to an error, then one over all, which asks only for what is missing."""
    rows, path = _asked(s, d), scratch(s, "resume")

    def flaky(messages: list, sample: int) -> str:
        if len(messages[-1]["content"]) % 2:
            raise ValueError("lost")
        return sc.stub_model(messages, sample)

    sc.score_once(rows.where("id % 3 = 0"), flaky, ["id"], path, retries=0)
    done = sc.score_once(rows, sc.stub_model, ["id"], path)
    return done.where("error is null").select("id", "response_text", "attempts", (F.col("id") % 3 == 0).alias("earlier"))
