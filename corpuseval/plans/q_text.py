"""Labels, responses, text keys and lines (C, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuseval.functions import labels as lb
from corpuseval.functions import responses as rp
from corpuseval.functions import textkeys as tk
from corpuseval.operators import lines as ln
from corpuseval.plans.fixtures import TIERS, articles, outcomes, table
from corpuseval.plans.registry import query

# The aliases of each tier, as in corpuseval.functions.labels.
_ALIAS_CASES = " ".join(f"when lower(trim({{c}})) in ({', '.join(repr(a) for a in names)}) then '{tier}'" for tier, names in lb.ALIASES.items())


def rank_sql(col: str) -> str:
    return f"case {_ALIAS_CASES.format(c=col)} end"


def label_sql(col: str) -> str:
    """C2 in SQL."""
    plain = f"lower(trim(regexp_replace({col}, '[*_#`.,!?\\n\\r]', '', 'g')))"
    return f"case when {plain} in ('exceptional', 'strong', 'fair', 'limited') then {plain} end"


def final_sql(col: str) -> str:
    """The answer part of C4 in SQL."""
    lines = f"list_filter(list_transform(string_split({col}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"case when regexp_matches({col}, '(?is)<final>.*?</final>') then regexp_extract({col}, '(?is)<final>\\s*(.*?)\\s*</final>', 1) else {lines}[-1] end"


def logp_map():
    return F.map_filter(F.create_map(*(c for t in TIERS for c in (F.lit(t), F.col(f"lp_{t}")))), lambda _, v: v.isNotNull())


#: The scores of an outcome as (label, logp) rows, best first by the canonical order.
SCORES_SQL = "scores as (select id, model, label, logp, k from (select id, model, unnest(['exceptional', 'strong', 'fair', 'limited']) as label, unnest([lp_exceptional, lp_strong, lp_fair, lp_limited]) as logp, unnest([0, 1, 2, 3]) as k from outcomes))"


@query("c1_normalize_rank", f"select id, {rank_sql('rank_raw')} as tier from articles")
def _(s, d):
    return articles(s, d).select("id", lb.normalize_rank("rank_raw").alias("tier"))


@query("c1_normalize_rank_numeric", "select id, case (id % 6)::int when 4 then 'exceptional' when 3 then 'strong' when 2 then 'fair' when 1 then 'limited' end as tier from articles")
def _(s, d):
    return articles(s, d).select("id", lb.normalize_rank((F.col("id") % 6) + F.lit(0.9), numeric=True).alias("tier"))


@query("c2_normalize_label", f"select id, model, {label_sql('response_text')} as label from outcomes")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.normalize_label("response_text").alias("label"))


@query("c3_normalize_label_plain", "select id, model, case when lower(trim(prediction)) in ('exceptional', 'strong', 'fair', 'limited') then lower(trim(prediction)) end as label from outcomes")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.normalize_label_plain("prediction").alias("label"))


@query("c4_reasoning_and_final", f"select id, model, {label_sql(final_sql('response_text'))} as label, nullif(regexp_extract(response_text, '(?is)<think>\\s*(.*?)\\s*</think>', 1), '') as reasoning from outcomes")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.parse_reasoning_and_final("response_text").alias("r")).select("id", "model", "r.*")


@query("c5_logp_top2", f"with {SCORES_SQL}, r as (select *, row_number() over (partition by id, model order by coalesce(logp, '-infinity'::double) desc, k) as nth from scores) select id, model, max(case when nth = 1 then label end) as top1, max(case when nth = 1 then logp end) as top1_logp, max(case when nth = 2 then label end) as top2, max(case when nth = 2 then logp end) as top2_logp from r group by id, model")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.logp_top2(logp_map()).alias("t")).select("id", "model", "t.*")


@query("c6_logp_argmax", f"with {SCORES_SQL} select id, model, first(label order by logp desc, k) filter (where logp is not null) as best from scores group by id, model")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.logp_argmax(logp_map()).alias("best"))


@query("c7_logp_sorted_pairs", f"with {SCORES_SQL} select id, model, string_agg(label, ',' order by logp desc, k) filter (where logp is not null) as ranked from scores group by id, model")
def _(s, d):
    return outcomes(s, d).select("id", "model", F.array_join(F.transform(lb.logp_sorted_pairs(logp_map()), lambda p: p["label"]), ",").alias("ranked"))


@query("c8_logp_argmax_alpha", f"with {SCORES_SQL} select id, model, first(label order by logp desc, label) filter (where logp is not null) as best from scores group by id, model")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.logp_argmax_alpha(logp_map()).alias("best"))


@query("c9_token_to_label", "select id, case when lower(trim(rank_raw)) in ('exceptional', 'strong', 'fair', 'limited') then lower(trim(rank_raw)) when contains(lower(rank_raw), 'except') then 'exceptional' end as label from articles")
def _(s, d):
    return articles(s, d).select("id", lb.token_to_label("rank_raw").alias("label"))


def _chat(s, d):
    """A stored chat response for each outcome that has scores: two tokens with candidates."""
    cand = F.filter(F.array(*(F.struct(F.lit(t).alias("token"), F.col(f"lp_{t}").alias("logprob")) for t in TIERS)), lambda c: c["logprob"].isNotNull())
    first = F.struct(F.lit("x").alias("token"), F.lit(-9.5).alias("logprob"), cand.alias("top_logprobs"))
    second = F.struct(F.lit(" Strong").alias("token"), F.lit(-1.25).alias("logprob"), F.slice(cand, 1, 1).alias("top_logprobs"))
    choice = F.struct(F.struct(F.col("response_text").alias("content")).alias("message"), F.struct(F.array(first, second).alias("content")).alias("logprobs"))
    return outcomes(s, d).select("id", "model", rp.parsed(F.to_json(F.struct(F.array(choice).alias("choices"))), "chat").alias("r"))


def _tiers(m):
    return [F.try_element_at(m, F.lit(t)).alias(t) for t in TIERS]


@query("c10_first_position_logp", "select id, model, lp_exceptional as exceptional, lp_strong as strong, lp_fair as fair, lp_limited as limited from outcomes")
def _(s, d):
    return _chat(s, d).select("id", "model", *_tiers(rp.first_position_logp(F.col("r"))))


@query("c11_max_position_logp", "select id, model, lp_exceptional as exceptional, greatest(lp_strong, -1.25::double) as strong, lp_fair as fair, lp_limited as limited from outcomes")
def _(s, d):
    return _chat(s, d).select("id", "model", *_tiers(rp.max_position_logp(F.col("r"))))


@query("c12_chat_text", "select id, model, response_text as text from outcomes")
def _(s, d):
    return _chat(s, d).select("id", "model", rp.chat_text(F.col("r")).alias("text"))


def _response(s, d):
    text = F.array(F.struct(F.lit("output_text").alias("type"), F.col("title").alias("text")), F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("output_text").alias("type"), F.col("type").alias("text")))
    none = F.lit(None)
    item = F.struct(F.lit("message").alias("type"), text.alias("content"), none.cast("array<struct<text:string>>").alias("summary"), none.cast("string").alias("encrypted_content"))
    think = F.struct(F.lit("reasoning").alias("type"), none.cast("array<struct<type:string,text:string>>").alias("content"), F.array_repeat(F.struct(F.lit("s").alias("text")), (F.col("id") % 3).cast("int")).alias("summary"), F.when(F.col("id") % 2 == 0, "enc").alias("encrypted_content"))
    body = F.struct(F.lit("m").alias("model"), F.when(F.col("id") % 5 == 0, F.array(item)).otherwise(F.array(think, item)).alias("output"), F.struct(F.struct(F.col("id").alias("reasoning_tokens")).alias("output_tokens_details")).alias("usage"))
    return articles(s, d).select("id", rp.parsed(F.to_json(body), "response").alias("r"))


@query("c12_output_text", "select id, title || chr(10) || type as text from articles")
def _(s, d):
    return _response(s, d).select("id", rp.output_text(F.col("r")).alias("text"))


@query("c13_reasoning_meta", "select id, id % 5 <> 0 as has_reasoning, case when id % 5 = 0 then 0 else (id % 3)::int end as summary_count, id % 5 <> 0 and id % 2 = 0 as encrypted, id as reasoning_tokens, 'm' as model from articles")
def _(s, d):
    return _response(s, d).select("id", rp.reasoning_meta(F.col("r")).alias("m")).select("id", "m.*")


@query("c14_split_thought_parts", "select id, case when id % 2 = 0 then 'think' end as reasoning, case when id % 2 = 0 then type else title || chr(10) || type end as answer from articles")
def _(s, d):
    part = lambda c, t: F.struct(c.alias("text"), F.lit(t).alias("thought"))
    parts = F.concat(F.when(F.col("id") % 2 == 0, F.array(part(F.lit("think"), True))).otherwise(F.slice(F.array(part(F.lit("think"), True)), 1, 0)), F.array(part(F.col("title"), False), part(F.col("type"), False)))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    return articles(s, d).select("id", rp.split_thought_parts(rp.parsed(body, "candidates")).alias("r")).select("id", "r.*")


_JOURNAL_KEY = "trim(regexp_replace(regexp_replace(replace(replace(lower(journal), '&', ' and '), '?', ' '), '\\bthe\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("c15_journal_key", f"select id, {_JOURNAL_KEY} as k from articles")
def _(s, d):
    return articles(s, d).select("id", tk.journal_key("journal").alias("k"))


@query("c16_alnum_key", "select id, regexp_replace(lower(journal), '[^a-z0-9]', '', 'g') as k from articles")
def _(s, d):
    return articles(s, d).select("id", tk.alnum_key("journal").alias("k"))


@query("c17_identifier_key", "select page_id, regexp_replace(replace(lower(trim(url)), ' ', ''), '^/doi/', '') as k from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tk.identifier_key("url").alias("k"))


_TOKENS = "list_filter(list_distinct(string_split_regex(regexp_replace(lower(journal), '[^\\w\\s]', ' ', 'g'), '\\s+')), lambda x: x <> '')"


@query("c18_title_tokens", f"select id, array_to_string(list_sort({_TOKENS}), ' ') as tokens from articles")
def _(s, d):
    return articles(s, d).select("id", F.array_join(F.array_sort(tk.title_tokens("journal")), " ").alias("tokens"))


@query("c19_token_f1", f"with t as (select id, {_TOKENS} as t, ['journal', 'of', 'src1'] as r from articles) select id, round(coalesce(2.0 * len(list_intersect(t, r)) / (len(t) + len(r)), 0), 6) as f1 from t where t is not null")
def _(s, d):
    ref = F.array(F.lit("journal"), F.lit("of"), F.lit("src1"))
    return articles(s, d).where("journal is not null").select("id", F.round(tk.token_f1(tk.title_tokens("journal"), ref), 6).alias("f1"))


_NUMBER = "case {c} when 'exceptional' then 4 when 'strong' then 3 when 'fair' then 2 when 'limited' then 1 end"


@query("c20_tier_distance", f"select id, model, abs({_NUMBER.format(c='truth')} - {_NUMBER.format(c='lower(trim(prediction))')}) as distance from outcomes")
def _(s, d):
    return outcomes(s, d).select("id", "model", lb.tier_distance("truth", "prediction").alias("distance"))


@query("c21_pair_key", "select id, trim(coalesce(journal, '')) as first, trim(title) as second from articles")
def _(s, d):
    return articles(s, d).select("id", tk.pair_key("journal", "title").alias("k")).select("id", "k.*")


@query("c22_null_words", "select id, case when trim(v) in ('', 'N/A', 'null', 'None') then null else trim(v) end as v from (select id, case id % 4 when 0 then ' N/A ' when 1 then 'null' when 2 then '  ' else type end as v from articles)")
def _(s, d):
    return articles(s, d).select("id", tk.null_words(F.expr("case id % 4 when 0 then ' N/A ' when 1 then 'null' when 2 then '  ' else type end")).alias("v"))


@query("c23_parse_json_answer", "select id, type as kind, journal as venue from articles where journal is not null")
def _(s, d):
    a = articles(s, d).where("journal is not null").withColumn("answer", F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("type").alias("kind"), F.col("journal").alias("venue")))))
    return a.select("id", rp.parse_json_answer("answer", ["kind", "venue"]).alias("r")).select("id", "r.*")


_NAMED = "case page_id % 5 when 0 then ' .. ' when 1 then url || chr(127) || repeat('x', 300) || '.html' else url end"


@query("c24_safe_file_key", f"""
with n as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NAMED}, '[<>:"/\\\\|?*]', '_', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g'), '^[. ]+', ''), '[. ]+$', '') as k from pages)
select page_id, case when k = '' then 'unnamed' when length(k) > 255 then left(k, 255 - length(regexp_extract(k, '\\.[^.]*$'))) || regexp_extract(k, '\\.[^.]*$') else k end as k from n""")
def _(s, d):
    return table(s, d, "pages").select("page_id", tk.safe_file_key(F.expr(_NAMED)).alias("k"))


@query("c25_join_context", "select id, concat_ws(chr(10), nullif(journal, ''), nullif(title, ''), split) as c from articles")
def _(s, d):
    return articles(s, d).select("id", tk.join_context("journal", "title", "split").alias("c"))


@query("c26_path_name", "select page_id, string_split(url, '/')[-1] as name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') as stem from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tk.path_name("url").alias("name"), tk.path_stem("url").alias("stem"))


@query("c27_clean_text", "select doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(text, ' ', chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as h from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tk.clean_text(F.translate("text", " ", "\r"))).alias("h"))


@query("c28_upper_key", "select doc_id, nullif(upper(trim(lang)), '') as k from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tk.upper_key("lang").alias("k"))


@query("c29_render_label", f"select id, coalesce(upper(substr({rank_sql('rank_raw')}, 1, 1)) || substr({rank_sql('rank_raw')}, 2), trim(rank_raw)) as label from articles")
def _(s, d):
    return articles(s, d).select("id", lb.render_label("rank_raw").alias("label"))


@query("b28_first_text", "select id, case when trim(rq_with_context) <> '' then 'abstract' when trim(title) <> '' then 'title' end as field from articles")
def _(s, d):
    return articles(s, d).select("id", tk.first_text(("abstract", "rq_with_context"), ("title", "title"))["field"].alias("field"))


_LINES = "l as (select doc_id, n_lines, i as line_no, parts[i + 1] as line from (select doc_id, string_split(text, chr(10)) as parts, len(string_split(text, chr(10)))::int as n_lines from documents) cross join lateral (select unnest(range(0, n_lines))::int as i))"
#: Documents as pages: broken and hyphenated lines, heads and tails, tables, blanks and numbers; one SQL text for Spark and DuckDB.
_BROKEN = "case when length(text) < 4000 then replace(replace(replace(text, ', ', ',' || chr(10)), ' de ', ' de-' || chr(10)), '. ', '.' || chr(10)) else text end"
_PAGE = f"""case doc_id % 8 when 0 then 'Page ' || (doc_id % 50) || chr(10) || {_BROKEN} when 1 then {_BROKEN} || chr(10) || '12-34' || chr(10) || '7'
 when 2 then 'ABSTRACT' || chr(10) || 'A HEADING OF CAPITALS' || chr(10) || {_BROKEN} when 3 then 'Table 2' || chr(10) || 'a b' || chr(10) || '1.5, 2' || chr(10) || '3' || chr(10) || {_BROKEN}
 when 4 then '© 2019 Some Press' || chr(10) || {_BROKEN} || chr(10) || 'DOI' when 5 then 'Introduction' || chr(10) || chr(10) || {_BROKEN} || chr(10) || chr(10) || '3 of 9'
 when 6 then {_BROKEN} || chr(10) || 'no end here' || chr(10) || '412' || chr(10) || 'more to read in this line, and it ends.' || chr(10) || 'a' || chr(10) || 'b of c, d' || chr(10) || 'f' || chr(10) || 'g' || chr(10) || '99' else {_BROKEN} end"""
_PAGE_LINES = _LINES.replace("from documents", f"from (select doc_id, {_PAGE} as text from documents)")
_WS = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"
_IS_UPPER, _IS_LOWER = r"(regexp_matches(t, '\p{Lu}') and not regexp_matches(t, '[\p{Ll}\p{Lt}ªº]'))", r"regexp_matches(t, '^[\p{Ll}ªº]')"
_MARKS = f"""f as (select doc_id, n_lines, line_no, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') as t from l),
t as (select *, length(t) between 1 and 50 and (regexp_matches(t, '(?i)^(table|figure|quadrant){_WS}+[IVX0-9]') or regexp_matches(t, '^([\\p{{Nd}}.,]|{_WS})+$') or length(t) < 30 and ({_IS_UPPER} or len(string_split_regex(t, '{_WS}+')) <= 3) or regexp_matches(t, '\\t|{_WS}{{3,}}')) as table_like from f),
r as (select doc_id, min(line_no) as first_line, max(line_no) as last_line from (select *, line_no - row_number() over (partition by doc_id order by line_no) as island from t where table_like) group by doc_id, island having count(*) >= 3)"""


def _lines(s, d):
    return ln.explode_lines(table(s, d, "documents"), "doc_id", "text")


def _page_lines(s, d):
    return ln.explode_lines(table(s, d, "documents").select("doc_id", F.expr(_PAGE).alias("text")), "doc_id", "text")


@query("k1_explode_lines", f"with {_LINES} select doc_id, line_no, n_lines, md5(line) as h from l")
def _(s, d):
    return _lines(s, d).select("doc_id", "line_no", "n_lines", F.md5("line").alias("h"))


@query("k2_table_like", f"with {_PAGE_LINES}, {_MARKS} select doc_id, line_no from t where table_like")
def _(s, d):
    return _page_lines(s, d).where(ln.table_like("line")).select("doc_id", "line_no")


@query("k3_table_regions", f"with {_PAGE_LINES}, {_MARKS} select doc_id, first_line, last_line from r")
def _(s, d):
    return ln.table_regions(_page_lines(s, d), "doc_id")


# The twin of K4 and K5 reads each page line by line: what was seen, the line before, the open paragraph, and those that are done.
_PAGES_READ = f"""g as (select t.*, r.doc_id is not null as in_table, line_no < 5 or line_no >= n_lines - 5 as zone,
  length(t) <= 50 and regexp_matches(t, '(?i)^(\\p{{Nd}}{{1,4}}|\\p{{Nd}}+[-/]\\p{{Nd}}+|page{_WS}+\\p{{Nd}}+|\\p{{Nd}}+{_WS}*of{_WS}*\\p{{Nd}}+)$') as number,
  length(t) <= 50 and (length(t) < 5 or regexp_matches(t, '(?is)(^\\p{{Nd}}+$|^page{_WS}+\\p{{Nd}}|^\\p{{Nd}}+{_WS}+\\||wileyonlinelibrary\\.com|©.*\\p{{Nd}}{{4}}|^([a-z]|{_WS})+\\p{{Nd}}{{4}};)')) as footer,
  regexp_matches(t, '(?i)^((table|figure){_WS}+\\p{{Nd}}|quadrant{_WS}+[ivx])') or ({_IS_UPPER} and length(t) between 11 and 99) or regexp_matches(lower(t), '^(abstract|keywords|introduction|conclusion|references|acknowledgments|appendix|results|discussion|methods|methodology)') as special,
  contains(t, '©') or contains(upper(t), 'DOI') as metadata, {_IS_LOWER} as goes_lower from t left join r on t.doc_id = r.doc_id and t.line_no between r.first_line and r.last_line),
page as (select doc_id, -1 as line_no, false as seen, '' as before, null::varchar as para, []::varchar[] as done, '' as kind, n_lines from g where line_no = 0
 union all select doc_id, line_no, seen or kind = 'page_number' or (kind = 'text' and number and not in_table and before <> '' and not goes_lower and right(before, 1) not in ('-', ',', ';', ':', '，', '；', '：', '.', '!', '?', '。', '！', '？')),
  case when kind in ('blank', 'page_number') or (kind = 'header_footer' and metadata) then '' when kind = 'header_footer' then before else t end,
  case when kind = 'header_footer' and not metadata then para when kind <> 'text' then null when para is null or starts then t when right(before, 1) = '-' then left(para, length(para) - 1) || t else para || ' ' || t end,
  done || case when para is not null and (kind in ('blank', 'page_number', 'special') or (kind = 'header_footer' and metadata) or (kind = 'text' and starts)) then [para] else [] end
   || case when kind = 'page_number' then ['[Journal Page: ' || t || ']'] when kind = 'header_footer' and metadata then ['[Metadata: ' || t || ']'] when kind = 'special' then [t] else [] end,
  kind, n_lines
 from (select p.seen, p.before, p.para, p.done, g.*, not in_table and right(p.before, 1) in ('.', '!', '?', '。', '！', '？') and not goes_lower as starts,
   case when t = '' then 'blank' when zone and number and not seen then 'page_number' when zone and footer and not in_table then 'header_footer' when special then 'special' else 'text' end as kind
  from page p join g on g.doc_id = p.doc_id and g.line_no = p.line_no + 1))"""


@query("k4_line_class", f"with recursive {_PAGE_LINES}, {_MARKS}, {_PAGES_READ} select doc_id, line_no, kind from page where line_no >= 0")
def _(s, d):
    return ln.line_class(_page_lines(s, d), "doc_id").select("doc_id", "line_no", "kind")


@query("k5_restore_paragraphs", f"with recursive {_PAGE_LINES}, {_MARKS}, {_PAGES_READ}, whole as (select doc_id, done || case when para is not null then [para] else [] end as ps from page where line_no = n_lines - 1) select doc_id, i::integer as paragraph_no, ps[i] as paragraph from whole cross join lateral (select unnest(range(1, len(ps) + 1)) as i)")
def _(s, d):
    return ln.restore_paragraphs(ln.line_class(_page_lines(s, d), "doc_id"), "doc_id")


_PAGES = "regexp_replace(regexp_replace(replace(string_agg(text, chr(10) || chr(10) order by turn, text), chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("k6_join_pages", f"with p as (select conv_id, coalesce({_PAGES}, '') as content from conversations group by conv_id) select conv_id, md5(content) as content, case when content = '' then 'failed' else 'content_parsed' end as status from p")
def _(s, d):
    return ln.join_pages(table(s, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("content").alias("content"), "status")
