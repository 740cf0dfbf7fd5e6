"""The corpus operators' queries, each over whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import collocations, conversation_trie, decontamination, embedding_dedup, langid, line_dedup, minhash, mixing, passages, substring_dedup, tokens, toxicity, url_filter
from plumbline.llm.common import table


def tokenizer_path() -> str:
    """PLUMBLINE_TOKENIZER if set, else the public vocabulary file that is installed beside Python."""
    if named := os.environ.get("PLUMBLINE_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 200)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.all_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.phrases(table(spark, sf_dir, "documents"), least=100), 2000)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))


#: Host, path and verdict of the rules that the contract names.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.UrlFilter(rules).judged(table(spark, sf_dir, "pages"), "page_id")


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_embedding_dedup": op2_embedding_dedup, "op3_substring_dedup": op3_substring_dedup, "op4_toxicity": op4_toxicity, "op5_language_id": op5_language_id, "op6_mixing": op6_mixing, "op7_token_output": op7_token_output, "op8_decontamination": op8_decontamination, "op9_minhash": op9_minhash, "op10_passages": op10_passages, "op11_collocations": op11_collocations, "op12_conversation_trie": op12_conversation_trie, "op13_url_filter": op13_url_filter}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Pairs (a, b) with a < b to the smallest id that each id of ``ids`` reaches.
_REACH = """
edges as (select a, b from links union all select b, a from links),
reach(id, root) as (select id, id from ids union select edges.b, reach.root from reach join edges on edges.a = reach.id),
classes as (select id, min(root) as root from reach group by id)"""

SQL = {
    "op2_embedding_dedup": f"""
with recursive ids as (select vec_id as id from embeddings where vec_id is not null),
ok as (select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select p.id as a, q.id as b from ok as p join ok as q on p.label = q.label and len(p.e) = len(q.e) and p.id < q.id where list_cosine_similarity(p.e, q.e) >= 0.93),
{_REACH.strip()}
select id as vec_id, (select count(*) from edges where edges.a = id) as n_links, root as component_id, id = root as kept from classes""",
    "op3_substring_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
pieces as (select doc_id, p * 1000 as base, substr(h, 2000 * p + 1, 2398) as h from (select doc_id, h, unnest(range(len(h) // 2000 + 1)) as p from d)),
places as (select doc_id, base, h, unnest(range(least(1000, greatest(len(h) // 2 - 199, 0)))) as i from pieces),
w as (select doc_id, base + i as i, md5(substr(h, 2 * i + 1, 400)) as k from places),
hits as (select doc_id, i from w where k in (select k from w group by k having count(*) > 1)),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from hits),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked),
spans as (select doc_id, run, min(i) as s, max(i) + 200 as e from runs group by doc_id, run),
cuts as (select doc_id, run, s, e, coalesce(lag(e) over (partition by doc_id order by run), 0) as before from spans),
ends as (select doc_id, sum(e - s) as n, count(*) as k, max(e) as e from spans group by doc_id),
left_over as (select doc_id, run, substr(h, 2 * before + 1, 2 * (s - before)) as part from cuts join d using (doc_id)
  union all select doc_id, 1000000000, substr(h, 2 * e + 1) from ends join d using (doc_id)),
kept as (select doc_id, string_agg(part, '' order by run) as h from left_over group by doc_id)
select doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(k, 0) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join ends using (doc_id) left join kept using (doc_id)""",
    "op9_minhash": f"""
with recursive docs as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w
  from documents where doc_id is not null),
ids as (select id from docs),
places as (select id, w, unnest(range(greatest(len(w) - 3, 0) + 1)) as i from docs where len(w) > 0),
sets as (select distinct id, array_to_string(w[i + 1 : i + 3], ' ') as s from places),
sizes as (select id, count(*) as n from sets group by id),
pairs as (select p.id as a, q.id as b, count(*) as m from sets as p join sets as q on p.s = q.s and p.id < q.id group by p.id, q.id),
links as (select a, b from pairs join sizes as x on x.id = a join sizes as y on y.id = b where 100 * m >= 85 * (x.n + y.n - m)),
{_REACH.strip()}
select id as doc_id, coalesce(n, 0) as n_shingles, root as component_id, id = root as kept from classes left join sizes using (id)""",
    "op1_line_dedup": f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents where doc_id is not null),
lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs),
keyed as (select doc_id, pos, line, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as k from lines),
frequent as (select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (select keyed.*, coalesce(last <> doc_id, false) as gone from keyed left join frequent using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op8_decontamination": f"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) as ws
  from documents where doc_id is not null),
items as (select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_WORD}) as ws
  from benchmark where item_id is not null and text is not null),
cuts as (select item_id, ws, unnest(range(greatest(len(ws) - 10, 0) + 1)) as i from items where len(ws) > 0),
windows as (select distinct cast(item_id as varchar) as item_id, least(len(ws), 10) as n, array_to_string(ws[i + 1 : i + 10], ' ') as w from cuts),
lengths as (select distinct n from windows),
places as (select doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) as i from docs, lengths),
grams as (select doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') as w from places),
hits as (select doc_id, grams.n, i, item_id from grams join windows using (w)),
spots as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(n)) as j from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join spots using (doc_id) left join named using (doc_id)""",
    "op13_url_filter": f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(h, p, v) as (values {', '.join(str(r) for r in URL_RULES)}),
fits as (select host, path, h || p as rule, v, row_number() over (partition by host, path order by length(h || p) desc, length(h) desc) as i
  from (select distinct host, path from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, parts.host, parts.path, rule, coalesce(v, 'allow') as verdict from parts left join fits on fits.host = parts.host and fits.path = parts.path and i = 1""",
    "op12_conversation_trie": """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) - 1 as pos, role, text from c),
digits as (select conv_id, unnest(range(1, 1 + length(cast(conv_id as varchar)))) as i from (select distinct conv_id from c)),
steps as (select conv_id, flatten(list([cast(ascii(substr(cast(conv_id as varchar), i, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1] order by i)) as s from digits group by conv_id),
ids as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, s), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint) % 9 as h from steps),
copied as (select ids.conv_id, t.pos, role, text from ids join t on t.conv_id = ids.conv_id - ids.conv_id % 5 and t.pos < h),
kept as (select t.conv_id, t.pos - h + (select count(*) from copied where copied.conv_id = t.conv_id) as pos, role, text from t join ids using (conv_id) where t.pos >= h),
r as (select * from copied union all select * from kept),
p as (select conv_id, pos + 1 as depth, md5(cast(list(struct_pack(role, text)) over (partition by conv_id order by pos) as varchar)) as k, strlen(text) as b from r
  union all select conv_id, 0, '', 0 from ids),
q as (select conv_id, depth, b, min(conv_id) over (partition by depth, k) as node, depth = max(depth) over (partition by conv_id) as ends from p),
n as (select node, depth, count(*) as n_convs, any_value(b) as b, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as ends from q group by node, depth),
e as (select n.node, n.depth, n_convs, n.b, n.ends, q.node as up from n left join q on q.conv_id = n.node and q.depth = n.depth - 1),
kids as (select up as node, depth - 1 as depth, count(*) as n_children from e where up is not null group by all),
f as (select e.*, coalesce(n_children, 0) as n_children from e left join kids using (node, depth)),
below as (select q.node, q.depth, count(*) filter (f.n_children = 0) as n_leaves, cast(sum((f.n_convs - 1) * f.b) as bigint) as saved_tokens
  from f join q on q.conv_id = f.node and q.depth <= f.depth group by q.node, q.depth)
select node as conv_id, depth, up as parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from f join below using (node, depth)""",
    "op11_collocations": f"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as x from documents),
pieces as (select lang, regexp_extract_all(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from t),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
totals as (select lang, count(*) as n from places group by lang),
grams as (select lang, k, w[i : i + k - 1] as p from places, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w)),
f as (select lang, k, p, count(*) as f from grams group by all having count(*) >= 100),
links as (select lang, p[2:] as p, f from f where k > 2 union all select lang, p[: k - 1], f from f where k > 2),
kept as (select f.lang, f.k, f.p, f.f as a from f left join (select lang, p, max(f) as g from links group by all) as g on g.lang = f.lang and g.p = f.p where f.k > 1 and (g is null or 100 * g < 100 * f.f)),
cuts as (select lang, k, p, a, unnest(range(1, k)) as j from kept),
scored as (select c.lang, c.p, c.a, j, x.f as l, y.f as r, n, cast(1000::hugeint * c.a * n // (x.f::hugeint * y.f) as bigint) as score
  from cuts as c join f as x on x.lang = c.lang and x.p = c.p[: c.j] join f as y on y.lang = c.lang and y.p = c.p[c.j + 1 :] join totals on totals.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank, array_to_string(p, ' ') as phrase, a, l, r, n, score
from best qualify rank <= 2000""",
}
