"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import numpy as np

from plumbline.functions.text import ANSWER, stems_pattern
from plumbline.operators.generate import CITIES, HOBBIES, NAMES, NET_WORTH, OCCUPATIONS
from plumbline.operators.narrative import BANDS, KEYS, LEVELS, OPENINGS, ORDERINGS, PASTIMES, WORTH
from plumbline.operators.stats import mixed32, poisson_limits
from plumbline.plans.queries import CONFIG, HEDGE_MAX, LEXICON, OPTIONS, PATTERN, PRIORITIES, RHO_MIN
from plumbline.sources.config import BANNED_STEMS, SUITABILITY


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


_PRIORITY = f"(list_position({_list(PRIORITIES)}, o_orderpriority) - 1) / {_d(4)}"
_STATUS = f"(list_position(['F', 'O', 'P'], o_orderstatus) - 1) / {_d(2)}"
_PRICE = f"(o_totalprice - {_d(1000)}) / {_d(499000)}"
_SCORED = f"""
with raw as (select o_orderkey, o_totalprice, c_mktsegment, c_nationkey,
    {_d(100)} * ((({_d(0.4)} * ({_PRIORITY}) + {_d(0.3)} * ({_PRICE})) + {_d(0.2)} * ((c_acctbal - {_d(-1000)}) / {_d(11000)})) + {_d(0.1)} * ({_STATUS})) as s
  from orders join customer on o_custkey = c_custkey),
scored as (select *, case when s < 40 then 'conservative' when s <= 70 then 'moderate' else 'aggressive' end as tier from raw)"""
_BLANK = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{_BLANK}]+')"


def _stems(words) -> str:
    return stems_pattern(words).replace(r"(?iU)\b(?:", r"(?i)(?:^|[^\pL\pN_])((?:").replace(r")\w*", r")[\pL\pN_\pM]*)")


_STEMS = _stems(LEXICON)
_HITS = f"regexp_extract_all(text, '{_STEMS}', 1)"
_TEMPLATE = "(with k as (select md5('42|' || cast(doc_id as varchar)) as m) select (16 * (cast('0x' || substr(m, 1, 8) as bigint) + cast('0x' || substr(m, 9, 8) as bigint) + cast('0x' || substr(m, 17, 8) as bigint)) + cast('0x' || substr(m, 25, 8) as bigint)) % 24 from k)"
_TEMPLATE_ID = f"printf('tmpl_%02d_%d', cast({_TEMPLATE} // 4 as integer), cast({_TEMPLATE} % 4 as integer))"
_VIGNETTES = "select doc_id, case when source = 'src3' then 'pairs' when n_chars > 2000 then 'explicit' else 'implicit' end as bucket from documents"
_ROT = "(select unnest(range(4)) as perm_idx)"
_CONDITIONS = "(select 'baseline' as condition union all select 'instruction')"


def _slots(sep: str) -> str:
    o = _list(OPTIONS)
    return f" || '{sep}' || ".join(f"{o}[cast((perm_idx + {k}) % 4 + 1 as integer)]" for k in range(4))


_PROMPT = " || chr(10) || ".join(
    [
        f"'{CONFIG.framing}'",
        "'The client writes:'",
        "text",
        "'To choose from:'",
        *[f"'[{letter}] ' || {_list(OPTIONS)}[cast((perm_idx + {k}) % 4 + 1 as integer)]" for k, letter in enumerate("ABCD")],
        f"'{ANSWER}'",
    ]
)
_READ = """
with l as (select vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) as x, list_transform([0, 5, 10, 15], lambda j: 20 + (vec_id * 3 + j) % 40) as ids from embeddings),
e as (select vec_id, ids, x, list_max(x) as top, list_sum(list_transform(x, lambda y: exp(y - list_max(x)))) as total from l),
s as (select vec_id, list_contains(ids, list_position(x, top) - 1) as is_letter, list_transform(ids, lambda i: exp(x[i + 1] - top) / total) as m from e),
r as (select vec_id, is_letter, list_sum(m) as p_letters, """ + ", ".join(f"m[{i + 1}] / greatest(list_sum(m), CAST(1e-9 AS DOUBLE)) as p{i}" for i in range(4)) + " from s)"
_RESULTS = (
    _READ
    + """,
units as (select vec_id // 4 as vignette, vec_id % 4 as k, * from r),
res as (select vignette, """
    + ", ".join(f"avg(case (4 + {i} - k) % 4 when 0 then p0 when 1 then p1 when 2 then p2 else p3 end) as a{i}" for i in range(4))
    + """, avg(p_letters) as p_letters, avg(cast(is_letter as double)) as f from units group by vignette),
final as (select *, 0.2 * a0 + 0.4 * a1 + 0.7 * a2 + 0.9 * a3 as aggressiveness, p_letters < 0.5 or f < 0.5 as hedged from res)"""
)
_RANKED = "select {by} as g, rank() over (partition by {by} order by s) + (count(*) over (partition by {by}, s) - 1) / 2.0 as rx, rank() over (partition by {by} order by o_totalprice) + (count(*) over (partition by {by}, o_totalprice) - 1) / 2.0 as ry from scored"
_DELTAS = """
with c as (select user_id, event_type, avg(value) as v from events where event_type in ('click', 'view') group by user_id, event_type),
d as (select b.user_id, round(a.v - b.v, 6) as delta from c as b join c as a using (user_id) where b.event_type = 'click' and a.event_type = 'view')"""
_SHINGLES = f"""
with t as (select doc_id, {_tokens('lower(text)')} as w from documents),
i as (select doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) as i from t),
sh as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as s from i)"""
_MODE = "case when lang = 'en' then 'implicit' else 'explicit' end"


def _mixed(rows: str, keep: str, start: str, out: str) -> str:
    """A subquery of ``rows`` with stats.mixed32 of ``start``, a step at a time."""
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        rows, start = f"(select {keep}, (xor(v, v >> {shift}) * {times}::ubigint) & 4294967295::ubigint as w from (select {keep}, {start} as v from {rows}))", "w"
    return f"(select {keep}, xor(w, w >> 16) as {out} from {rows})"


_LIMITS = ", ".join(f"({c}, {poisson_limits(c)[1].tolist()}::ubigint[])" for c in range(1, 20))  # cells of up to 19 rows
_BOOTSTRAP = f""", k as (select c_mktsegment as g, rank() over (partition by c_mktsegment order by s) - 1 as x, rank() over (partition by c_mktsegment order by o_totalprice) - 1 as y, count(*) over (partition by c_mktsegment) as n from scored),
cells as (select g, x * 1024 // n as a, y * 1024 // n as b, count(*) as c from k group by all),
hashed as {_mixed('cells', 'g, a, b, c', f'xor((a * 1024 + b)::ubigint, {int(mixed32(np.array([42], np.uint32))[0])}::ubigint)', 'h')},
turns as {_mixed('(select unnest(range(1, 2001))::ubigint as r)', 'r', 'r', 't')},
every as {_mixed('(select g, a, b, c, r, xor(h, t) as x from hashed, turns)', 'g, a, b, c, r', 'x', 'u')},
drawn as materialized (select g, a, b, r, len(list_filter(l, lambda v: v <= u)) as w from every join (values {_LIMITS}) as limits(c, l) using (c)),
xs as (select g, r, a, sum(sum(w)) over (partition by g, r order by a) - (sum(w) - 1) / 2.0 - (sum(sum(w)) over (partition by g, r) + 1) / 2.0 as x from drawn group by g, r, a),
ys as (select g, r, b, sum(sum(w)) over (partition by g, r order by b) - (sum(w) - 1) / 2.0 - (sum(sum(w)) over (partition by g, r) + 1) / 2.0 as y from drawn group by g, r, b),
placed as materialized (select g, r, b, w, x from drawn join xs using (g, r, a) where w > 0),
rho as (select g, r, sum(w * x * y) / sqrt(sum(w * x * x) * sum(w * y * y)) as rho from placed join ys using (g, r, b) group by g, r having sum(w * x * x) > 0 and sum(w * y * y) > 0)
select g as c_mktsegment, round(quantile_cont(rho, 0.025), 6) as ci_low, round(quantile_cont(rho, 0.975), 6) as ci_high from rho group by g"""

SQL = {
    "rubric_score_tier": _SCORED + " select o_orderkey, round(s, 6) as score, tier from scored",
    "subscores": f"select o_orderkey, round({_PRIORITY}, 8) as a_o_orderpriority, round({_PRICE}, 8) as a_o_totalprice, round({_STATUS}, 8) as a_o_orderstatus from orders",
    "tier_counts": _SCORED + " select tier, count(*) as n from scored group by tier",
    "tier_means": _SCORED + " select tier, round(avg(o_totalprice), 3) as mean_price, count(*) as n from scored group by tier",
    "contradiction_flags": f"select o_orderkey, greatest({_PRIORITY}, {_STATUS}) >= 0.8 and least({_PRIORITY}, {_STATUS}) <= 0.2 as contradictory from orders",
    "borderline_window": _SCORED + " select o_orderkey, round(s, 6) as score from scored where s between 38 and 42 or s between 68 and 72",
    "balanced_first_n_per_tier": _SCORED + " select o_orderkey, tier from scored qualify row_number() over (partition by tier order by o_orderkey) <= 200",
    "round_robin_assign": f"""with n as (select p_partkey, cast(row_number() over (order by p_partkey) - 1 as integer) as pos from part)
select p_partkey, pos, printf('e%05d', pos) as profile_id, {_list(CITIES)}[pos % 10 + 1] as city, {_list(NET_WORTH)}[pos % 4 + 1] as net_worth_band from n""",
    "band_lookup": "select p_partkey, case when p_size between 1 and 10 then 0 when p_size between 11 and 25 then 1 else 2 end as band from part",
    "tier_balance_check": """with g as (select lang, count(*) as n from documents group by lang), s as (select lang, n, n / sum(n) over () as share from g)
select lang, n, round(share, 8) as share, abs(share - 0.25) <= 0.2 as within from s""",
    "token_length_match": f"""with m as (select lang, avg(cast(len({_tokens('text')}) as double)) as m from documents group by lang), x as (select min(m) as lo, max(m) as hi from m)
select round(lo, 6) as lo, round(hi, 6) as hi, (hi - lo) / hi <= 0.1 as matched from x""",
    "lexicon_hits": f"select doc_id, cast(len({_HITS}) as integer) as n_hits, array_to_string({_HITS}, '|') as hits from documents",
    "lexicon_leak_gate": f"""with h as (select lang, len({_HITS}) > 0 as leak from documents), g as (select lang, count(*) as n, count(*) filter (leak) as leaks from h group by lang)
select lang, n, leaks, case when leaks = 0 then 'PASS' else 'FAIL' end as verdict from g""",
    "pattern_snippets_lookup": f"""with h as (select doc_id, text, length(regexp_extract(text, '(?s)^(.*?){PATTERN}', 1)) as pre, length(regexp_extract(text, '{PATTERN}')) as n
  from documents join labels using (doc_id) where coalesce(quality, 9) <= 0 and regexp_matches(text, '{PATTERN}'))
select doc_id, trim(substr(text, greatest(pre + 1 - 15, 1), pre + 1 + n + 15 - greatest(pre + 1 - 15, 1))) as snippet from h""",
    "shingle_counts": _SHINGLES + " select doc_id, cast(count(*) as integer) as n_shingles from sh group by doc_id",
    "near_dup_exact": _SHINGLES + """, n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh as a join sh as b using (s) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
d as (select distinct p.a from p join n as x on x.doc_id = p.a join n as y on y.doc_id = p.b where cast(i as double) / (x.n + y.n - i) >= 0.7)
select doc_id, d.a is not null as is_dup from documents left join d on d.a = doc_id""",
    "template_assignment": f"select doc_id, {_TEMPLATE_ID} as template_id from documents",
    "content_ids": "select doc_id, sha1('openai|gpt-4o-mini|implicit|' || text) as cache_id from documents",
    "twin_expansion": f"select 'v_' || cast(doc_id as varchar) || '_' || vignette_type as vignette_id, doc_id, vignette_type, {_TEMPLATE_ID} as template_id from documents, (select unnest(['explicit', 'implicit']) as vignette_type)",
    "bucket_routing": _VIGNETTES,
    "union_scan": f"select doc_id, case bucket when 'explicit' then 0 when 'implicit' then 1 else 2 end as source_order, md5(text) as text_md5 from ({_VIGNETTES}) join (select doc_id, text from documents) using (doc_id)",
    "option_rotations": f"select item_id, cast(perm_idx as integer) as perm_idx, {_slots(' / ')} as slots from benchmark, {_ROT}",
    "scoring_units": f"select doc_id, condition, cast(perm_idx as integer) as perm_idx, concat_ws(',', perm_idx % 4, (perm_idx + 1) % 4, (perm_idx + 2) % 4, (perm_idx + 3) % 4) as perm from labels, {_CONDITIONS}, {_ROT} where condition = 'baseline' or toxic = 1",
    "prompt_text": f"select item_id, condition, cast(perm_idx as integer) as perm_idx, md5(case when condition = 'instruction' then '{CONFIG.instruction}' || chr(10) else '' end || {_PROMPT}) as prompt_md5 from benchmark, {_CONDITIONS}, {_ROT} where condition = 'baseline' or item_id % 2 = 0",
    "letter_readout": _READ + f" select vec_id, {', '.join(f'round(p{i}, 6) as letter_{i}' for i in range(4))}, round(p_letters, 6) as p_letters, is_letter as argmax_is_letter from r",
    "allocation_probs": _RESULTS + f" select vignette, {', '.join(f'round(a{i}, 6) as alloc_{i}' for i in range(4))} from final",
    "advice_scores": _RESULTS + " select vignette, round(aggressiveness, 6) as aggressiveness, round(p_letters, 6) as p_letters, hedged from final",
    "hedge_rate": _RESULTS + " select count(*) as n, round(avg(cast(hedged as double)), 4) as hedge_rate from final",
    "spearman_by_group": _SCORED + f", k as ({_RANKED.format(by='c_mktsegment')}) select g as c_mktsegment, round(corr(rx, ry), 6) as rho, count(*) as n from k group by g having count(*) >= 10 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0",
    "gate_decision": _SCORED + f", k as ({_RANKED.format(by='1')}), rho as (select round(corr(rx, ry), 4) as rho from k)," + _RESULTS.lstrip()[5:] + f""",
h as (select round(avg(cast(hedged as double)), 4) as hedge_rate from final)
select rho, hedge_rate, coalesce(rho, -1) >= {RHO_MIN} as rho_pass, hedge_rate < {HEDGE_MAX} as hedge_pass, case when coalesce(rho, -1) >= {RHO_MIN} and hedge_rate < {HEDGE_MAX} then 'PASS' else 'FAIL' end as verdict from h, rho""",
    "wilcoxon_statistic": _DELTAS + """, r as (select delta, abs(delta) as a from d where delta <> 0),
k as (select delta, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as r, count(*) over (partition by a) as t from r)
select count(*) as n, coalesce(sum(r) filter (delta > 0), 0) as w_plus, coalesce(sum(r) filter (delta < 0), 0) as w_minus, cast(sum(t * t - 1) as double) as ties from k""",
    "paired_delta": _DELTAS + " select count(*) as n_pairs, round(avg(delta), 6) as mean_delta, round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high from d having count(*) >= 10",
    "uncached_jobs": "select doc_id as cache_id from documents where doc_id not in (select doc_id from labels)",
    "cache_lookup": "select doc_id as cache_id, coalesce('cached-' || cast(quality as varchar), '(none)') as cached_text from documents left join labels using (doc_id)",
    "request_dedup": f"""with j as (select distinct text, {_MODE} as mode from documents)
select sha1('openai|gpt-4o-mini|' || mode || '|' || text) as custom_id, md5(case when mode = 'implicit' then text || chr(10) || chr(10) || 'Leave out all of these words and their forms: {', '.join(LEXICON)}.' else text end) as prompt_md5 from j""",
    "collect_fallbacks": f"""with j as (select {_MODE} as mode, case when quality = 1 then trim(text) end as c, text from documents join labels using (doc_id)),
g as (select c is null as err, coalesce(c <> '' and not (mode = 'implicit' and len({_HITS}) > 0), false) as good from j)
select count(*) as cached, count(*) filter (not good) as fallbacks, count(*) filter (err) as errors from g""",
    "stratified_sample": "select doc_id, lang from documents qualify row_number() over (partition by lang order by doc_id) <= greatest(1, 200 // (select count(distinct lang) from documents))",
    "seeded_limit": "select doc_id from documents order by md5('42|' || cast(doc_id as varchar)), doc_id limit 100",
    "fixed_batches": "select doc_id, (row_number() over (order by doc_id) - 1) // 32 as batch from documents",
    "distinct_coverage": "select count(distinct p_brand) as n_p_brand, count(distinct p_type) as n_p_type, count(distinct p_size) as n_p_size from part",
    "resumed_rewrites": f"""with j as (select doc_id, text, {_MODE} as mode from documents),
k as (select *, sha1('openai|gpt-4o-mini|' || mode || '|' || text) as id, reverse(left(case when mode = 'implicit' then text || chr(10) || chr(10) || 'Leave out all of these words and their forms: {', '.join(LEXICON)}.' else text end, 40)) as said from j),
l as (select *, mode = 'implicit' and len({_HITS.replace('text', 'said', 1)}) > 0 as leaks from k)
select doc_id, md5(case when substr(id, 1, 1) < 'a' then 'had' when leaks then text else said end) as final_md5, case when substr(id, 1, 1) < 'a' then 'earlier' when leaks then 'template-only' else 'gpt-4o-mini' end as model from l""",
    "rewrites_in_order": "select item_id, md5(reverse(left(text, 40))) as final_md5, 'gpt-4o-mini' as model, true as in_order from benchmark",
    "bootstrap_ci": _SCORED + _BOOTSTRAP,
}
#: Verified, so it has no false ones; at its banding a pair that is just at the threshold is missed once in 6,500.
SQL["near_dup_minhash"] = SQL["near_dup_exact"]
_TEXTS = f"""with v as (select doc_id, text, lang as tier, source is not distinct from 'src3' as pair, case when n_chars > 2000 then 'explicit' else 'implicit' end as kind from documents),
w as (select *, case when pair then 'pairs' else kind end as bucket, len({_tokens('text')}) as tokens, {_HITS} as hits from v)"""
SQL["all_checks"] = _TEXTS + f""",
shares as (select tier, count(*) as n, count(*) / sum(count(*)) over () as value from w where not pair group by tier),
means as (select kind, count(*) as n, avg(cast(tokens as double)) as value from w where not pair group by kind)
select 'count' as "check", bucket as part, count(*) as n, cast(count(*) as double) as value from w group by bucket
union all select 'leaks', 'implicit', count(*), cast(count(*) filter (kind = 'implicit' and len(hits) > 0) as double) from w
union all select 'share', tier, n, round(value, 6) from shares union all select 'mean_tokens', kind, n, round(value, 6) from means
union all select 'balanced', null, cast(sum(n) as bigint), cast(max(abs(value - 1 / 3)) <= {CONFIG.tier_balance_tol} as double) from shares
union all select 'matched', null, cast(sum(n) as bigint), cast((max(value) - min(value)) / max(value) <= {CONFIG.token_len_tol} as double) from means"""
SQL["check_examples"] = _TEXTS + """ select 'leak' as kind, cast(row_number() over (order by doc_id) as integer) as i, doc_id as vignette_id, count(*) over () as n, array_to_string(hits, '|') as hits
from w where kind = 'implicit' and len(hits) > 0 qualify i <= 10"""


def _draw(n: int, *key: str) -> str:
    """text.drawn; each part of the key is SQL of a string."""
    joined = " || '|' || ".join(key)
    return f"cast(cast('0x' || substr(md5({joined}), 1, 8) as bigint) % {n} as integer)"


def _one(values, *key: str) -> str:
    return f"{_list(values)}[{_draw(len(values), *key)} + 1]"


def _fields(*key: str) -> str:
    out = []
    for f in SUITABILITY.fields:
        h = ("'42'", f"'{f.name}'", *key)
        out.append(f"{_one(f.levels, *h) if f.levels else f'{_draw(f.range[1] - f.range[0] + 1, *h)} + {f.range[0]}'} as {f.name}")
    return ", ".join(out)


def _filler(*key: str) -> str:
    pools = {"net_worth_band": NET_WORTH, "occupation": OCCUPATIONS, "hobbies": HOBBIES, "city": CITIES, "name": [n for n, _ in NAMES]}
    out = [f"{_one(v, chr(39) + '42' + chr(39), chr(39) + k + chr(39), *key)} as {k}" for k, v in pools.items()]
    gender = _one([g for _, g in NAMES], "'42'", "'name'", *key)
    return ", ".join([*out, f"{gender} as gender_hint"])


def _sub(name: str) -> str:
    f = SUITABILITY.field(name)
    if f.levels:
        return f"(list_position({_list(f.levels)}, {name}) - 1) / {_d(len(f.levels) - 1)}"
    a = f"(cast({name} as double) - {_d(f.range[0])}) / {_d(f.range[1] - f.range[0])}"
    return f"({_d(1)} - {a})" if f.invert else a


_SCORE = f"{_d(100)} * ({' + '.join(f'{_d(f.weight)} * ({_sub(f.name)})' for f in SUITABILITY.fields)})"
_SCORE_TIER = "cast(round(cast(s as decimal(18, 9)), 2) as double) as risk_score, case when s < 40 then 'conservative' when s <= 70 then 'moderate' else 'aggressive' end as tier"
_GOALS = [_sub(n) for n in ("stated_goal", "past_drawdown_reaction")]
_CONTRADICTS = f"greatest({_GOALS[0]}, {_GOALS[1]}) >= 0.8 and least({_GOALS[0]}, {_GOALS[1]}) <= 0.2"
_KEY = "cast(c_custkey as varchar)"
_CLIENTS = f"""with drawn as (select c_custkey as draw, printf('p%05d', c_custkey) as profile_id, {_fields(_KEY)}, {_filler(_KEY)} from customer),
clients as (select * exclude (s), {_SCORE_TIER} from (select *, {_SCORE} as s from drawn))"""


def _said(field: str) -> str:
    """narrative.verbalize, as it is picked for the profile and the type."""
    key = (f"'{field}'", "'42'", "profile_id", "vignette_type")
    if field == "hobbies":
        return f"replace({_one(PASTIMES, *key)}, '%s', hobbies)"
    if field == "net_worth":
        return "case net_worth_band " + " ".join(f"when '{v}' then {_one(texts, *key)}" for v, texts in WORTH.items()) + " end"
    if field in BANDS:
        cases = [(f"{field} between {lo} and {hi}", said) for lo, hi, *said in BANDS[field]]
    else:
        cases = [(f"{field} = '{v}'", said) for (f, v), said in LEVELS.items() if f == field]
    return "case " + " ".join(f"when {when} and vignette_type = '{mode}' then {_one(texts, *key)}" for when, said in cases for mode, texts in zip(("explicit", "implicit"), said, strict=True)) + " end"


def _opened(text: str) -> str:
    parts = ["'" + x.replace("'", "''") + "'" for x in text.split("%s")]
    return " || ".join(x for pair in zip(parts, ("name", "cast(age as varchar)", "occupation", "city", "''"), strict=True) for x in pair)


_OPENING = "case cast(substr(template_id, 6, 2) as integer) " + " ".join(f"when {i} then {_opened(o)}" for i, o in enumerate(OPENINGS)) + " end"
_NARRATIVE = f"""said as (select *, {_OPENING} as opening, [{', '.join(_said(k) for k in KEYS)}] as lines, {[list(o) for o in ORDERINGS]}[cast(substr(template_id, 9, 1) as integer) + 1] as sorted from jobs),
told as (select *, opening || ' ' || array_to_string(list_transform(sorted, lambda i: lines[i + 1]), ' ') as text from said)
select vignette_id, profile_id, pair_id, tier, risk_score, vignette_type, template_id, {_CONTRADICTS} as contradictory, 'template-only' as paraphrase_model,
  case when vignette_type = 'implicit' then array_to_string({_HITS.replace(_STEMS, _stems(BANNED_STEMS))}, '|') else '' end as banned_terms, text from told"""
_TEMPLATE_OF = _TEMPLATE_ID.replace("cast(doc_id as varchar)", "{key}")
SQL["generated_profiles"] = _CLIENTS + " select * exclude (draw) from clients"
SQL["generated_edges"] = _CLIENTS + f""", hard as (select draw, risk_score, tier, {_CONTRADICTS} as contradictory, s between 38 and 42 or s between 68 and 72 as borderline from (select *, {_SCORE} as s from clients)),
dealt as (select *, row_number() over (order by draw) - 1 as pos from hard where contradictory or borderline)
select * exclude (pos), {_list(OCCUPATIONS)}[pos % {len(OCCUPATIONS)} + 1] as occupation, {_list(CITIES)}[pos % {len(CITIES)} + 1] as city from dealt"""
SQL["twin_vignettes"] = _CLIENTS + f""",
jobs as (select *, 'v_' || profile_id || '_' || vignette_type as vignette_id, cast(null as varchar) as pair_id, {_TEMPLATE_OF.replace('{key}', 'profile_id')} as template_id
  from clients, (select unnest(['explicit', 'implicit']) as vignette_type)),
""" + _NARRATIVE
SQL["pair_vignettes"] = f"""with keys as (select pair_id, pair_id || '_' || side as key, wanted from (select printf('pair_%04d', s_suppkey) as pair_id from supplier),
  (values ('cons', 'conservative'), ('aggr', 'aggressive')) as sides(side, wanted)),
tries as (select pair_id, key, wanted, t, {_fields('key', 'cast(t as varchar)')} from keys, (select unnest(range(400)) as t)),
graded as (select * exclude (s), {_SCORE_TIER} from (select *, {_SCORE} as s from tries)),
first as (select * from graded where tier = wanted qualify row_number() over (partition by key order by t) = 1),
jobs as (select *, key as profile_id, 'v_' || key as vignette_id, 'implicit' as vignette_type, {_filler('pair_id')}, {_TEMPLATE_OF.replace('{key}', 'pair_id')} as template_id from first),
""" + _NARRATIVE
