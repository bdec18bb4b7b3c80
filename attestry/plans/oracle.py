"""DuckDB SQL for the queries of `workloads`, over the same tables."""

from __future__ import annotations

from attestry.plans.workloads import BOOT, FAMILIES, RULES, SEGMENTS

SQL: dict[str, str] = {}

CODE = "p_type || '-' || ((p_size - 1) // 10)::varchar"
ORDERS = """orders_ as (select o_orderkey as paper_id, c_mktsegment as scholar_key,
  case when year(o_orderdate) <= 1996 then '1' when year(o_orderdate) <= 1998 then '2' when year(o_orderdate) <= 2000 then '3' else '4' end as period,
  o_orderkey % 97 = 0 as seed, o_orderpriority like '1%' as urgent from orders join customer on o_custkey = c_custkey)"""


def split(rows: str, out: str, ratio: str = "0.2", given: str = "null") -> str:
    """rows(paper_id, scholar_key, seed) with `split` added. given: an expression for a split that a row already has."""
    return f"""{out}_a as (select *, case when seed then 'train' else {given} end as given_ from {rows}),
{out}_b as (select *, greatest(round_even(count(*) over (partition by scholar_key) * {ratio}, 0) - count(*) filter (given_ = 'heldout') over (partition by scholar_key), 0) as quota,
  row_number() over (partition by scholar_key, given_ is null order by sha256('2026:' || paper_id)) as place from {out}_a),
{out} as (select *, coalesce(given_, case when place <= quota then 'heldout' else 'train' end) as split from {out}_b)"""


BASKETS = f"""codes_ as (select distinct l_orderkey as paper_id, {CODE} as code, p_type as family from lineitem join part on l_partkey = p_partkey),
facts_ as (select l_orderkey as paper_id, bool_or(l_returnflag = 'R') as returned from lineitem group by 1)"""
RECORDS = f"""{ORDERS}, {split("orders_", "split_")}, {BASKETS},
records_ as (select s.paper_id, s.scholar_key, s.period, s.split, s.urgent, f.returned from split_ s join facts_ f using (paper_id)),
train_ as (select * from records_ where split = 'train')"""


def clause_sql(clause: str) -> str:
    if clause.startswith("field:"):
        return clause[6:]
    tests = [f"c.code like '{a[:-1]}%'" if a.endswith("-*") else f"c.code = '{a}'" for a in clause.split("|")]
    return f"exists (select 1 from codes_ c where c.paper_id = t.paper_id and ({' or '.join(tests)}))"


def rule_sql(requires: tuple[str, ...]) -> str:
    return " and ".join(clause_sql(c) for c in requires) if requires else "false"


SAT = "sat_ as (" + " union all ".join(f"select '{i}' as rule_id, '{k or ''}' as key_, '{'SH' if k is None else k[:2]}' as lens, t.*, coalesce({rule_sql(r)}, false) as sat from train_ t" for i, k, r in RULES) + ")"

SQL["rule_support"] = f"""with {RECORDS}, {SAT}, agg as (
  select rule_id, lens, count(*) filter (sat and scholar_key = key_) as n_support, count(*) filter (scholar_key = key_) as n_annotated,
    count(*) filter (sat and scholar_key <> key_) as n_other_support, count(*) filter (scholar_key <> key_) as n_other,
    count(distinct period) filter (sat and scholar_key = key_) as n_periods,
    coalesce(array_to_string(list_sort(list(distinct period) filter (sat and scholar_key = key_)), ','), '') as periods from sat_ where key_ <> '' group by 1, 2
), l as (select *, case when n_annotated > 0 and n_other > 0 then ((n_support + 0.5) / (n_annotated + 1)) / ((n_other_support + 0.5) / (n_other + 1)) end as lift_ from agg
), r as (select *, array_to_string(list_filter([case when n_support < 3 then 'papers' end, case when n_periods < 2 then 'periods' end, case when lift_ is null then 'no comparison' end, case when lift_ < 1.02 then 'lift' end], lambda x: x is not null), ',') as reasons from l)
select rule_id, lens, n_support, n_annotated, n_other_support, n_other, n_periods, periods, round(lift_, 6) as lift, reasons = '' as passed,
  case when reasons = '' then 'candidate' when n_annotated >= 10 then 'rejected' else 'insufficient_data' end as suggestion, reasons from r"""

SQL["rule_support_shared"] = f"""with {RECORDS}, {SAT}, agg as (
  select rule_id, count(*) filter (sat) as n_support, count(*) as n_annotated, count(distinct period) filter (sat) as n_periods,
    count(distinct scholar_key) filter (sat) / count(distinct scholar_key)::double as share_ from sat_ where key_ = '' group by 1
), r as (select *, array_to_string(list_filter([case when n_support < 3 then 'papers' end, case when share_ < 0.6 then 'share' end], lambda x: x is not null), ',') as reasons from agg)
select rule_id, n_support, n_annotated, n_periods, round(share_, 6) as share, reasons = '' as passed, case when reasons = '' then 'candidate' when n_annotated >= 10 then 'rejected' else 'insufficient_data' end as suggestion, reasons from r"""

SQL["candidate_hits"] = f"""with {RECORDS}, {SAT}
select rule_id, count(*) as candidate_annotated, count(*) filter (sat and (key_ = '' or scholar_key = key_)) as candidate_hits from sat_ where paper_id between 1 and 399 group by 1"""

SQL["code_matrix"] = f"""with {RECORDS} select code, {", ".join(f"count(*) filter (scholar_key = '{s}') as {s}" for s in SEGMENTS)} from train_ join codes_ using (paper_id) group by 1"""

SQL["mine_combos"] = f"""with {RECORDS}, r as (select paper_id, scholar_key, period, code from train_ join codes_ using (paper_id)),
combos as (
  select paper_id, scholar_key, period, code as combo, 1 as size from r
  union all select a.paper_id, a.scholar_key, a.period, a.code || ' + ' || b.code, 2 from r a join r b on a.paper_id = b.paper_id and a.code < b.code
  union all select a.paper_id, a.scholar_key, a.period, a.code || ' + ' || b.code || ' + ' || c.code, 3 from r a join r b on a.paper_id = b.paper_id and a.code < b.code join r c on b.paper_id = c.paper_id and b.code < c.code
), per as (select combo, size, scholar_key, count(*) as n, count(distinct period) as p from combos group by 1, 2, 3),
tot as (select *, sum(n) over (partition by combo) as nt from per),
sizes as (select scholar_key, count(*) as n_inside, sum(count(*)) over () as n_all from train_ group by 1),
l as (select scholar_key, combo, size, n, n_inside, (nt - n)::bigint as n_out, (n_all - n_inside)::bigint as n_outside, ((n + 0.5) / (n_inside + 1)) / ((nt - n + 0.5) / (n_all - n_inside + 1)) as lift_ from tot join sizes using (scholar_key) where n >= 3 and p >= 2 and n_inside >= 3 and n_all > n_inside),
k as (select *, row_number() over (partition by scholar_key order by lift_ desc, n desc, size, combo) as place from l where lift_ >= 1.5)
select scholar_key, combo, size::bigint as size, n, n_inside, n_out, n_outside, round(lift_, 6) as lift, place from k where place <= 30"""

COVER_RULES = [(i, k, r) for i, k, r in RULES if k is not None]


def cover_sql(requires: tuple[str, ...]) -> str:
    if not requires:
        return "false"
    tests = []
    for c in requires:
        if c.startswith("field:"):
            return "false"
        tests.append("(" + " or ".join(f"x like '{a[:-1]}%' or y like '{a[:-1]}%'" if a.endswith("-*") else f"x = '{a}' or y = '{a}'" for a in c.split("|")) + ")")
    return " and ".join(tests)


SQL["rule_cover"] = f"""with {RECORDS}, r as (select paper_id, scholar_key, code from records_ join codes_ using (paper_id)),
pairs as (select distinct a.scholar_key, a.code as x, b.code as y from r a join r b on a.paper_id = b.paper_id and a.code < b.code)
select scholar_key, x || ' + ' || y as combo, array_to_string(list_filter([{", ".join(f"case when scholar_key = '{k}' and {cover_sql(r)} then '{i}' end" for i, k, r in COVER_RULES)}], lambda x: x is not null), ',') as covered from pairs"""

SQL["select_rows"] = f"with {ORDERS} select paper_id, scholar_key, period from orders_ where paper_id between 1 and 12"
SQL["period_bins"] = f"with {ORDERS} select scholar_key, period, count(*) as n from orders_ group by 1, 2"
SQL["corpus_status"] = """with p as (select d.doc_id, source, 'p' || doc_id % 4 as period, case doc_id % 3 when 0 then 'verified' when 1 then 'partial' else '' end as v, case doc_id % 5 when 0 then 'heldout' when 1 then '' else 'train' end as split, length(text) >= 1000 as t,
  exists (select 1 from labels l where l.doc_id = d.doc_id) as a from documents d)
select source as scholar_key, count(*) as n, count(*) filter (v = 'verified') as verified, count(*) filter (v = 'partial') as partly, count(*) filter (t) as with_text, count(*) filter (a) as annotated, count(*) filter (split = 'train') as train, count(*) filter (split = 'heldout') as heldout, count(*) filter (split = '') as unsplit,
  array_to_string(list_sort(list(distinct period)), '、') as periods from p group by 1"""
SQL["stable_ids"] = """with o as (select o_orderkey, substr(c_mktsegment, 1, 2) as k, year(o_orderdate)::varchar as y from orders join customer on o_custkey = c_custkey),
given as (select *, lpad(o_orderkey::varchar, 2, '0') as nn from o where o_orderkey <= 40), most as (select k, y, max(nn::int) as m from given group by 1, 2),
fresh as (select o.*, coalesce(m, 0) + row_number() over (partition by o.k, o.y order by o_orderkey) as num from o left join most on o.k = most.k and o.y = most.y where o_orderkey > 40)
select k || '-' || y || '-' || nn as paper_id, k as scholar_key, y as year, lpad(o_orderkey::varchar, 12, '0') as title from given
union all select k || '-' || y || '-' || case when num < 10 then '0' || num else num::varchar end, k, y, lpad(o_orderkey::varchar, 12, '0') from fresh"""
SQL["hash_rank"] = "select doc_id, sha256('2026:' || doc_id) as rank, sha256(text) as text_sha256 from documents"
PAPERS = "papers_ as (select doc_id as paper_id, source as scholar_key, doc_id % 31 = 0 as seed from documents)"
SQL["sticky_split"] = f"with {PAPERS}, {split('papers_', 's')} select paper_id, scholar_key, split from s"
SQL["split_growth"] = f"""with {PAPERS}, even_ as (select * from papers_ where paper_id % 2 = 0), {split("even_", "f")},
all_ as (select paper_id, scholar_key, seed, split as was from f union all select paper_id, scholar_key, seed, null from papers_ where paper_id % 2 <> 0), {split("all_", "s", "0.3", "was")} select paper_id, scholar_key, split from s"""
FOLD = r"lower(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
SQL["dedupe_import"] = f"with k as (select doc_id, sha256({FOLD.format('text')}) as key from documents) select min(doc_id) as doc_id, key from k group by key"

SQL["fold_ascii"] = f"select doc_id, sha256({FOLD.format('text')}) as folded_sha256, length({FOLD.format('text')}) as n from documents"
LINES = """lines_ as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents)"""
SQL["numbered_text"] = f"with {LINES} select doc_id, md5(array_to_string(list_transform(ls, lambda p, i: '[P' || i || '] ' || p), chr(10))) as numbered_md5 from lines_"
WRAPPED = f"""{LINES}, u as (select doc_id, unnest(ls) as p, generate_subscripts(ls, 1) as i from lines_),
f as (select *, length(p) <= 30 and regexp_matches(p, '^[0-9]+(\\.[0-9]+)*[、.．\\s]') as alone, right(p, 1) = '.' as final_ from u),
g as (select *, coalesce(sum((alone or prev_end)::int) over (partition by doc_id order by i), 0) as grp from (select *, coalesce(lag(alone or final_) over (partition by doc_id order by i), false) as prev_end from f)),
h as (select doc_id, grp, string_agg(p, '' order by i) as par from g group by 1, 2)"""
SQL["hard_wrapped_text"] = f"""with {WRAPPED}
select d.doc_id, count(par) as n, md5(coalesce(string_agg(par, chr(10) order by grp), '')) as pars_md5 from documents d left join h using (doc_id) group by 1"""
SQL["paragraphs"] = f"""with {WRAPPED},
kind_ as (select doc_id, len(ls) >= 5 or length(text) < 3000 as lines from documents join lines_ using (doc_id)),
both_ as (select doc_id, i as p_no, p from u join kind_ using (doc_id) where lines union all select doc_id, row_number() over (partition by doc_id order by grp), par from h join kind_ using (doc_id) where not lines)
select doc_id, p_no, length(p) as n_chars, md5(p) as p_md5 from both_"""
SQL["cjk_density"] = "select lang, count(*) filter (length(regexp_replace(text, '[^一-鿿]', '', 'g')) > 0.3 * length(text)) as heavy, count(*) as n from documents group by 1"
SQL["locator_parse"] = """with p as (select doc_id, 'P' || (doc_id % 50 + 1) || '-P' || (n_chars % 90 + 1) as loc, least(doc_id % 50 + 1, n_chars % 90 + 1) as lo, greatest(doc_id % 50 + 1, n_chars % 90 + 1) as hi from documents)
select doc_id, loc, array_to_string(range(lo, least(hi, lo + 20) + 1), ',') as located from p"""
SPAN = r"coalesce(regexp_replace(substr({}, 1, {}), '[\x20\x09-\x0D]+', '', 'g'), '')"
SQL["abstract_span"] = f"select doc_id, substr({SPAN.format('text', 400)}, 1, 1500) as abstract from documents"
SQL["stored_abstracts"] = f"select doc_id as paper_id, case when doc_id % 3 = 0 then 'stored ' || doc_id when doc_id % 2 = 0 then {SPAN.format('text', 60)} else '' end as abstract from documents"
SQL["full_text_choice"] = """with f as (select doc_id, case when doc_id % 5 = 0 then case when doc_id % 2 = 0 and not (doc_id % 4 <> 0 and doc_id % 7 = 0) then '.md' end
  when doc_id % 4 = 0 then '.md' when doc_id % 7 = 0 then null else '.txt' end as ext, substr(text, 1, 200) as text from documents)
select doc_id::varchar as paper_id, 'file:/t/' || doc_id || ext as path, md5(ext || ' ' || text) as text_md5 from f where ext is not null"""
SQL["half_text"] = "select doc_id, md5(case when coalesce(length(text), 0) = 0 then '(none)' else substr(text, 1, greatest(1, length(text) // 2)) end) as half_md5 from documents"
SQL["template_fill"] = "select item_id, 'Item ' || item_id || ': ' || text || ' (' || item_id || ')' as prompt from benchmark"
SQL["comment_strip"] = "select page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) as bare_md5 from pages"

QUOTES = f"""{LINES}, q_ as (select d.doc_id as paper_id, k, coalesce(case k when 0 then substr(ls[1], 1, 60) when 1 then substr(text, 20, 80) when 2 then substr(ls[1], 1, 30) || 'zzqx' when 3 then substr(text, 1, 4) when 4 then substr(text, 1, 151) else substr(ls[1], 1, 40) end, '') as quote,
  case k when 0 then [1] when 1 then [] when 5 then [2, 3] else [1] end as at_, ls from documents d join lines_ using (doc_id), range(6) t(k)),
n_ as (select *, {FOLD.format("quote")} as q, {FOLD.format("array_to_string(ls, '')")} as whole, list_filter(at_, lambda i: i <= len(ls)) as valid from q_),
s_ as (select paper_id, k, case when length(quote) > 150 then 'too_long' when length(q) < 6 then 'too_short'
  when len(valid) > 0 and contains({FOLD.format("coalesce(array_to_string(list_transform(valid, lambda i: ls[i]), ''), '')")}, q) then 'exact'
  when contains(whole, q) then case when len(valid) > 0 then 'loc_mismatch' else 'exact' end else 'miss' end as status from n_)"""
SQL["quote_check_keyed"] = f"with {QUOTES} select paper_id, k, status from s_"
SQL["quote_check"] = f"""with q as (select item_id as quote_id, {FOLD.format("substr(text, 1, 100)")} as q from benchmark), t as (select doc_id as paper_id, {FOLD.format("text")} as t from documents)
select quote_id, paper_id from q join t on contains(t, q) where q <> ''"""
RATE = f"{QUOTES}, rate_ as (select paper_id, count(*) as n_quotes, count(*) filter (status in ('exact', 'loc_mismatch', 'fuzzy')) / count(*)::double as r from s_ group by 1)"
SQL["hit_rate"] = f"with {RATE} select paper_id, n_quotes, round(r, 6) as hit_rate from rate_"
SQL["evidence_gate"] = f"with {RATE} select paper_id, paper_id % 11 <> 0 and n_quotes > 0 and round(r, 6) >= 0.5 as passed from rate_"
SQL["load_records"] = """select doc_id as paper_id, source as scholar_key, lang as period, case when doc_id % 2 = 0 then 'train' else '' end as split,
  case when quality = 1 then 'Q-1,' else '' end || 'T-' || toxic as codes, case when toxic = 1 then 'puzzle' else '' end as fields from labels join documents using (doc_id)"""
SQL["record_problems"] = """select doc_id as paper_id, doc_id || '.json' as file, case when quality = 1 then 'another annotation came first' else 'verification failed' end as reason from labels join documents using (doc_id)
  union all select -doc_id - 1, (-doc_id - 1) || '.json', 'not in the registry' from labels
  union all select doc_id, doc_id || '.json', 'not in the registry' from labels, range(2) where doc_id not in (select doc_id from documents)"""
EVIDENCE_TOLD = "needs a quote of 4 to 200 characters and a loc of 2 or more"
ANNOTATED = f"""a_ as (select doc_id::varchar as paper_id, doc_id % 8 as k, text, {FOLD.format("substr(coalesce(text, ''), 1, 60)")} as q, substr(coalesce(text, ''), 1, 60) as own from documents),
e_ as (select *, list_sort(list_filter([case when k = 1 then 'codebook_version: form' end, case when k = 2 then 'paper_type: unknown value' end, case when k = 3 then 'fields/puzzle: missing' end, case when k = 3 then 'fields: unexpected x' end,
  case when k = 4 then 'fields/puzzle: present without value and evidence' end, case when k = 5 then 'moves/1/evidence: {EVIDENCE_TOLD}' end, case when k = 6 then 'moves/0: needs a code and evidence' end, case when k = 7 then 'unknown properties: colour' end,
  case when length(own) < 4 then 'fields/actors/evidence: {EVIDENCE_TOLD}' end, case when length(own) < 4 and k <> 6 then 'moves/0/evidence: {EVIDENCE_TOLD}' end], lambda x: x is not null)) as errors from a_)"""
SQL["schema_check"] = f"with {ANNOTATED} select paper_id, array_to_string(errors, '; ') as schema_errors from e_"
VERIFIED = f"""{ANNOTATED}, v_ as (select *, length(q) >= 6 as ok, (k <> 6)::int as known from e_),
r_ as (select *, 1 + known + 1 as n_quotes, case when ok then 1 + known else 0 end as hits, case when k = 5 then 'too_short' else 'miss' end as last from v_)"""
SQL["verify_annotations"] = f"""with {VERIFIED} select paper_id, case when len(errors) = 0 and k <> 6 and hits / n_quotes::double >= 0.5 then 'PASS' else 'FAIL' end as verdict, n_quotes::bigint as n_quotes, round(hits / n_quotes::double, 6) as hit_rate,
  len(errors) as n_schema_errors, (k = 6)::bigint as n_unknown_codes from r_"""
SQL["verification_stamps"] = f"""with {VERIFIED} select paper_id, len(errors) = 0 and k <> 6 and hits / n_quotes::double >= 0.5 as passed, sha256(coalesce(text, '')) as fulltext_sha256,
  case when ok and k <> 6 then 'Q-1' else '' end as verified_moves, case when ok or k = 6 then 'T-0' else 'Q-1,T-0' end as unsupported_moves, case when ok then 'actors' else '' end as verified_fields,
  hits::bigint as exact, (case when k = 5 then 0 else 1 end)::bigint as miss from r_"""
SQL["prompt_status"] = f"""with {LINES}, t_ as (select doc_id, case when doc_id % 9 <> 0 then text end as text, ls from documents join lines_ using (doc_id)),
s_ as (select *, case when coalesce(text, '') = '' then 'no_text' when length(text) > 4000 then 'too_long' else 'ready' end as status from t_)
select doc_id as paper_id, status, case when status = 'ready' then md5('Title ' || doc_id || chr(10) || coalesce(array_to_string(list_transform(ls, lambda p, i: '[P' || i || '] ' || p), chr(10)), '')) end as prompt_md5,
  sha256('{{{{TITLE}}}}' || chr(10) || '{{{{TEXT}}}}' || chr(10) || '0.3.0') as prompt_sha256, status = 'ready' and doc_id % 4 <> 0 as pending from s_"""
KAPPA = """select {by} count(*) as n, round(avg((quality = toxic)::int), 6) as p_observed, round(case when {pe} < 1 then (avg((quality = toxic)::int) - {pe}) / (1 - {pe}) when avg((quality = toxic)::int) >= 1 then 1 end, 6) as kappa from labels {join} {group}"""
PE = "(avg(quality) * avg(toxic) + avg(1 - quality) * avg(1 - toxic))"
SQL["kappa_labels"] = KAPPA.format(by="", pe=PE, join="", group="")
SQL["kappa_by_source"] = KAPPA.format(by="source,", pe=PE, join="join documents using (doc_id)", group="group by source")
SQL["kappa_by_family"] = f"""with l as (select l_orderkey as o, l_linenumber as ln, {CODE} as code, p_type as family from lineitem join part on l_partkey = p_partkey),
papers as (select count(distinct o) as n from l), dim as (select distinct {CODE} as code, p_type as family from part), size as (select family, count(*) as s from dim group by 1),
m as (select o, code, family, bool_or(ln <= 2) as a, bool_or(ln >= 2) as b from l group by all), c as (select family, count(*) filter (a and b)::double as yy, count(*) filter (a and not b)::double as yn, count(*) filter (b and not a)::double as ny from m group by 1),
t as (select family, s * n as n, coalesce(yy, 0) as yy, coalesce(yn, 0) as yn, coalesce(ny, 0) as ny, (s * n)::double - coalesce(yy + yn + ny, 0) as nn from size cross join papers left join c using (family)),
k as (select family, n, (yy + nn) / n as po, ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n::double * n) as pe from t)
select family, n, round(po, 6) as p_observed, round(case when pe < 1 then (po - pe) / (1 - pe) when po >= 1 then 1 end, 6) as kappa, coalesce((po - pe) / (1 - pe) < 0.6, false) as flagged from k"""

EVENTS = """e_ as (select event_id, strftime(ts, '%d') as item_id, event_type as system, (user_id % 3)::varchar as rater, (floor(value)::bigint % 5 + 1)::double as value, (value > 60)::int as n, user_id, ts, props from events)"""
ALPHA_INTERVAL = """select {by}, count(*) as n_units, sum(m)::bigint as n_values, round(case when {de} <> 0 then 1 - (sum(apart / (m - 1)) / sum(m)) / ({de} / (sum(m) * (sum(m) - 1)::double)) else 1 end, 6) as alpha from u where m > 1 group by {by}"""
DE = "(2 * (sum(m) * sum(s2) - sum(s1) * sum(s1)))"
SQL["kripp_interval"] = f"""with {EVENTS}, u as (select rater, event_id // 4 as unit, count(value)::double as m, sum(value) as s1, sum(value * value) as s2, 2 * (count(value) * sum(value * value) - sum(value) * sum(value)) as apart from e_ group by all)
{ALPHA_INTERVAL.format(by="rater", de=DE)}"""
SQL["kripp_nominal"] = f"""with {EVENTS}, r as (select rater, event_id // 4 as unit, system, event_id, count(*) over (partition by rater, event_id // 4) as m from e_),
p as (select a.rater, sum((a.system <> b.system)::int / (a.m - 1)::double) as o from r a join r b on a.rater = b.rater and a.unit = b.unit and a.event_id <> b.event_id where a.m > 1 group by 1),
k as (select rater, system, count(*)::double as c from r where m > 1 group by 1, 2), t as (select rater, sum(c) as n, sum(c * c) as sq from k group by 1),
un as (select rater, count(distinct unit) as n_units from r where m > 1 group by 1)
select rater, n_units, n::bigint as n_values, round(1 - (o / n) / ((n * n - sq) / (n * (n - 1))), 6) as alpha from p join t using (rater) join un using (rater)"""


def boot(diffs: str, by: list[str], key: str, value: str = "d", out: str = "boot_") -> str:
    """CTEs that end in out(by..., n, mean, lo, hi) over diffs(by..., key, value)."""
    cols = "".join(f"{b}, " for b in by)
    part = f"partition by {', '.join(by)} " if by else ""
    on = " and ".join([f"p.{b} = r.{b}" for b in by] + ["p.i = r.i"])
    lo, hi = int(0.025 * BOOT), min(BOOT - 1, -int(-0.975 * BOOT // 1) - 1)
    return f"""{out}r as (select {cols}{value} as x, row_number() over ({part}order by {key}) - 1 as i from {diffs} where {value} is not null),
{out}s as (select {cols}count(*) as n, avg(x) as mean from {out}r {"group by " + ", ".join(by) if by else ""}),
{out}p as (select s.*, b, ('0x' || substr(md5('0:' || b || ':' || a), 1, 8))::ubigint % n as i from {out}s s, range({BOOT}) t(b), lateral (select unnest(range(n)) as a)),
{out}m as (select {"".join(f"p.{b}, " for b in by)}p.b, avg(r.x) as m from {out}p p join {out}r r on {on} group by all),
{out}q as (select {cols}list_sort(list(m)) as all_ from {out}m {"group by " + ", ".join(by) if by else ""}),
{out} as (select s.*, all_[{lo + 1}] as lo, all_[{hi + 1}] as hi from {out}s s join {out}q q on {" and ".join(f"s.{b} = q.{b}" for b in by) or "true"})"""


SQL["bootstrap_ci"] = f"with {EVENTS}, m as (select item_id, avg(value) as d from e_ group by 1), {boot('m', [], 'item_id')} select n, round(mean, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi from boot_"
SQL["set_f1"] = f"with {BASKETS}, c as (select paper_id, count(*) as n, count(*) filter (code in ('ECONOMY-0', 'LARGE-1', 'PROMO-2')) as tp from codes_ group by 1) select paper_id, round(2.0 * tp / (3 + n), 6) as f1 from c"

GOLD = f"""{RECORDS}, fam_ as (select unnest({list(FAMILIES)}) as family),
gold_ as (select r.paper_id, r.split, f.family, list_sort(list(c.code) filter (c.code is not null)) as gold from records_ r cross join fam_ f left join codes_ c on c.paper_id = r.paper_id and c.family = f.family group by all),
freq_ as (select family, code, count(*) as n from train_ join codes_ using (paper_id) where family in (select family from fam_) group by 1, 2),
k_ as (select family, greatest(1, coalesce(round_even(median(len(coalesce(gold, []))) filter (split = 'train'), 0), 1))::bigint as k from gold_ group by 1),
top_ as (select family, code, row_number() over (partition by family order by n desc, code) as place from freq_),
maj_ as (select t.family, list_sort(list(code)) as pred from top_ t join k_ using (family) where place <= k group by 1)"""
SQL["gold_by_family"] = f"with {GOLD} select paper_id, split, family, coalesce(array_to_string(gold, ','), '') as gold from gold_"
SQL["majority_topk"] = f"with {GOLD} select family, k, array_to_string(pred, ',') as pred from maj_ join k_ using (family)"
SQL["code_frequencies"] = f"with {GOLD} select family, code, n, round(n / sum(n) over (partition by family), 6) as share from freq_"
SQL["random_baseline"] = f"""with {GOLD}, pool_ as (select family, code, sum(n) over w as end_, sum(n) over w - n as begin_ from freq_ window w as (partition by family order by code rows unbounded preceding)),
size_ as (select family, sum(n)::bigint as all_ from freq_ group by 1), held_ as (select paper_id, family, coalesce(gold, []) as gold from gold_ where split = 'heldout'),
tries_ as (select h.paper_id, h.family, draw, i, k, case when i <= k + 8 then ('0x' || substr(md5('0:' || h.paper_id || ':' || draw || ':' || h.family || ':' || i), 1, 8))::bigint % all_ else i - k - 9 end as place from held_ h join size_ using (family) join k_ using (family), range(1, 21) d(draw), range(1, 400) t(i) where i <= k + 8 + least(k, all_)),
first_ as (select paper_id, family, draw, k, place, min(i) as i from tries_ group by all), taken_ as (select * from first_ qualify row_number() over (partition by paper_id, family, draw order by i) <= k),
drawn_ as (select paper_id, t.family, draw, list(distinct code) as pred from taken_ t join pool_ p on p.family = t.family and place >= begin_ and place < end_ group by 1, 2, 3),
f_ as (select h.paper_id, d.draw, 2.0 * len(list_intersect(pred, gold)) / (len(pred) + len(gold)) as f1 from drawn_ d join held_ h using (paper_id, family)), s_ as (select paper_id, draw, avg(f1) as s from f_ group by 1, 2)
select paper_id, round(avg(s), 6) as score from s_ group by 1"""
SCORES = f"""{GOLD}, pred_ as (select g.paper_id, 'majority' as system, g.family, m.pred, coalesce(g.gold, []) as gold from gold_ g join maj_ m using (family) where split = 'heldout'
  union all select paper_id, 'fixed', family, [family || '-1'], coalesce(gold, []) from gold_ where split = 'heldout'),
f1_ as (select paper_id, system, case when len(pred) = 0 and len(gold) = 0 then null else 2.0 * len(list_intersect(pred, gold)) / (len(pred) + len(gold)) end as f1 from pred_),
score_ as (select paper_id, system, avg(f1) as score from f1_ group by 1, 2)"""
SQL["holdout_scores"] = f"with {SCORES} select paper_id, system, round(score, 6) as score from score_"
SQL["holdout_summary"] = f"with {SCORES} select system, round_even(avg(score), 4) as mean_f1, count(*) as n from score_ where score is not null group by 1"
SQL["holdout_contrast"] = f"""with {SCORES},
diff as (select 'majority - fixed' as contrast, a.paper_id, a.score - b.score as d from score_ a join score_ b using (paper_id) where a.system = 'majority' and b.system = 'fixed'), {boot("diff", ["contrast"], "paper_id")},
pairs_ as (select contrast, count(*) as n_pairs from diff group by 1)
select contrast, n_pairs as n, round(round_even(mean, 4), 3) as mean, round(round_even(lo, 4), 3) as lo, round(round_even(hi, 4), 3) as hi from boot_ join pairs_ using (contrast)"""
SQL["model_predictions"] = f"""with dim_ as (select distinct {CODE} as code, p_type as family from part), f_ as (select unnest({list(FAMILIES)}) as family),
g_ as (select o_orderkey, family, case when o_orderkey % 5 = 0 then [] when family = 'ECONOMY' then ['ECONOMY-0', 'none', 'ECONOMY-' || o_orderkey % 6, 'PROMO-1', 'ECONOMY-2', 'ECONOMY-3'] when family = 'PROMO' and o_orderkey % 3 <> 0 then ['PROMO-1'] else [] end as given from orders cross join f_),
i_ as (select o_orderkey, family, unnest(given) as code, generate_subscripts(given, 1) as i from g_), k_ as (select i_.* from i_ join dim_ using (family, code)),
t_ as (select * from k_ qualify row_number() over (partition by o_orderkey, family order by i) <= 3), d_ as (select o_orderkey, family, code, min(i) as i from t_ group by all)
select g_.o_orderkey as paper_id, 'rules' as system, g_.family, coalesce(string_agg(code, ',' order by i), '') as pred from g_ left join d_ on d_.o_orderkey = g_.o_orderkey and d_.family = g_.family group by 1, 2, 3"""
SQL["holdout_prompts"] = """with h_ as (select doc_id, substr(text, 1, 101) as a, case doc_id % 3 when 0 then 'cases；records' when 1 then 'a survey' else '(not stated)' end as e from documents)
select doc_id as paper_id, s.system, md5(s.rules || '|book|T' || doc_id || '|' || case when coalesce(length(a), 0) = 0 then '(none)' else substr(a, 1, greatest(1, length(a) // 2)) end || '|' || e) as prompt_md5 from h_, (values ('baseline', ''), ('rules', 'R1')) s(system, rules)"""

SQL["blind_key"] = """with i as (select distinct conv_id::varchar as item_id from conversations), r as (select item_id, system, row_number() over (partition by item_id order by sha256('7:' || item_id || ':' || system)) as place from i, (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as system))
select item_id, chr((64 + place)::int) as label, system from r"""


KEYED = """i as (select distinct conv_id::varchar as item_id from conversations), key_ as (select item_id, system from i, (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as system)),
cell_ as (select *, ('0x' || substr(md5(item_id || ':' || system || ':' || rater || ':' || d), 1, 4))::bigint as w from key_, (select unnest(['R1', 'R2', 'R3']) as rater), (select unnest(['D1', 'D2', 'D3', 'D4', 'D5', 'D6', 'D7', 'D8', 'f']) as d))"""
SQL["sheet_ratings"] = f"with {KEYED} select system, d as dim, rater, count(*) as n, sum(w % 5 + 1)::double as total from cell_ where d <> 'f' and w % 7 <> 0 group by all"
SQL["sheet_fabrications"] = f"with {KEYED} select system, rater, count(*) as n_cells, sum(w % 3)::bigint as total from cell_ where d = 'f' and w % 9 <> 0 group by all"
SQL["blind_packets"] = """with f_ as (select conv_id::varchar as item_id, coalesce(arg_min(text, turn), '') as draft, arg_min(text, turn) as t from conversations group by 1), s_ as (select *, row_number() over (partition by item_id order by sha256('7:' || item_id || ':' || system)) as n from f_, (select unnest(['one', 'two']) as system))
select rater, substr(sha256('7:' || rater || ':' || item_id), 1, 12) as place, item_id, chr((64 + n)::int) as label, md5(system || ':' || substr(t, 1, 20)) as output_md5 from s_, (select unnest(['R1', 'R2']) as rater)"""


def dim(expr: str) -> str:
    return f"{EVENTS}, d_ as (select *, 'D' || ({expr}) as dim from e_)"


SQL["blind_scores"] = f"with {dim('event_id % 8 + 1')}, m as (select item_id, system, dim, avg(value) as m from d_ group by all) select system, dim, round(avg(m), 6) as mean from m group by 1, 2"
SQL["blind_vs_baseline"] = f"""with {dim("event_id % 2 + 6")}, m as (select item_id, system, dim, avg(value) as m from d_ group by all), diff as (select a.system, a.dim, a.item_id, a.m - b.m as d from m a join m b on a.item_id = b.item_id and a.dim = b.dim and b.system = 'view' where a.system <> 'view'),
{boot("diff", ["system", "dim"], "item_id")} select system, dim, n, round(mean, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi, case when dim in ('D7', 'D8') then lo > -0.5 end as noninferior from boot_"""
SQL["fabrication_rate"] = f"""with {EVENTS}, f as (select item_id, system, max((n > 0)::int)::double as flag from e_ group by 1, 2), r as (select system, round(avg(flag), 6) as rate, count(*) as n from f group by 1),
diff as (select a.system, a.item_id, a.flag - b.flag as d from f a join f b on a.item_id = b.item_id and b.system = 'view' where a.system <> 'view'), {boot("diff", ["system"], "item_id")}
select r.system, rate, r.n, round(mean, 6) as diff, hi < 0.05 as noninferior from r left join boot_ b on r.system = b.system"""
SQL["alpha_by_dimension"] = f"""with {dim("event_id % 8 + 1")}, u as (select dim, item_id, system, count(value)::double as m, sum(value) as s1, sum(value * value) as s2, 2 * (count(value) * sum(value * value) - sum(value) * sum(value)) as apart from d_ group by all)
{ALPHA_INTERVAL.format(by="dim", de=DE)}"""
SQL["comment_codes"] = """with c as (select (user_id % 7)::varchar as advisor, strftime(ts, '%Y-%m-%d') as draft, unnest([event_type, 'M-' || event_type]) as code, coalesce((props->>'$.k')::int % 2 = 0, false) as g from events)
select advisor, code, count(*) as n, count(distinct draft) as n_drafts, round(avg(g::int), 6) as share, count(*) >= 3 and count(distinct draft) >= 2 and avg(g::int) >= 0.5 as candidate from c group by 1, 2"""

TURNS = """r_ as (select conv_id, turn, role, sum((role = 'user')::int) over (partition by conv_id order by turn) as rec from conversations),
g_ as (select conv_id, rec, max(turn) filter (role = 'user') as t, list(role || turn order by turn) filter (role <> 'user') as names from r_ where rec > 0 group by 1, 2),
p_ as (select conv_id as file, 'Turn ' || t as title, coalesce(array_to_string(names, '、'), '') as authors, case when ltrim('0' || t, '0') = '' then '0' || t else ltrim('0' || t, '0') end as issue, (conv_id % 30 + 1995)::varchar as year,
  case when conv_id % 30 + 1995 <= 2009 then '≤2009' when conv_id % 30 + 1995 <= 2015 then '2010-2015' when conv_id % 30 + 1995 <= 2020 then '2016-2020' else '2021-2026' end as period,
  case when coalesce(len(names), 0) = 0 then '' when names = ['assistant1'] then 'sole' when names[1] = 'assistant1' then 'first' when list_contains(names, 'assistant1') then 'co' else '' end as author_role from g_)"""
SQL["import_ris"] = f"with {TURNS} select file, title, authors, issue, year, period, author_role from p_"
SQL["import_endnote"] = SQL["import_ris"]
SQL["import_new_papers"] = """with p_ as (select doc_id, case when doc_id % 3 = 0 then 'The ' || chr(39) || 'River' || chr(39) || ' ' else 'the river' end || substr(md5((doc_id % 400)::varchar), 1, 4) as title from documents), k_ as (select *, replace(replace(lower(title), chr(39), ''), ' ', '') as key from p_)
select doc_id as paper_id, title from k_ where doc_id % 2 <> 0 and key not in (select key from k_ where doc_id % 2 = 0) qualify row_number() over (partition by key order by doc_id) = 1"""
SQL["json_extract"] = "select event_id, (props->>'$.k')::bigint as k from events"
SQL["ref_check"] = """select coalesce(d.doc_id, l.doc_id) as key, case when l.doc_id is null then 'missing' when d.doc_id is null then 'extra' else 'stale' end as state from documents d full join labels l on d.doc_id = l.doc_id where l.doc_id is null or d.doc_id is null or d.doc_id % 2 <> l.quality"""
SQL["mention_check"] = """with n as (select distinct unnest(regexp_extract_all(html, '<a href="/([a-z]+)">', 1)) as name from pages), p as (select distinct lower(regexp_extract(text, '^[A-Za-z]+')) as name from documents where regexp_extract(text, '^[A-Za-z]+') <> '')
select name, 'missing' as state from n where name not in (select name from p) union all select name, 'unused' from p where name not in (select name from n)"""
