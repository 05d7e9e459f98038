"""Registered queries of this subpackage: name -> callable(spark, sf_dir) -> DataFrame, and their SQL for DuckDB."""

from pyspark.sql import functions as F

from . import alignment, decontaminate, divergence, html, jaccard, langid, lines, mixing, packing, quality, rules, sharding, urls
from .tables import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def remainder(modulus):
    """crc32 of doc_id as text, for splits into parts to learn from and parts held out; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


@query
def op1_language_id(spark, d):
    docs = table(spark, d, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    return langid.predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_quality_rules(spark, d):
    entries = rules.ledger(table(spark, d, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(rules.bits(rules.BASE))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base.alias("base_failed"), rules.judge(entries, rules.POLICIES[rules.CURRENT]).alias("kept"),
                          "failed")


SQL["op2_quality_rules"] = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
windows as (
  select rid, i, count(*) over (partition by rid, w) as times
  from (select rid, i, array_to_string(words[i:i + 4], ' ') as w
        from (select rid, words, unnest(range(1, len(words) - 3)) as i from d))),
covered as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from windows where times > 1)
  group by rid),
lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (
  select d.doc_id, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '\p{Ll}'))) as n_caps_words
  from d left join covered c using (rid) left join lines l using (rid)),
b as (
  select *, (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end)
    + (case when 100 * word_chars < 200 * n_words or 100 * word_chars > 1500 * n_words then 8 else 0 end)
    + (case when 100 * n_dup_lines > 30 * n_lines then 16 else 0 end)
    + (case when 100 * n_caps_words > 40 * n_words then 32 else 0 end) as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed,
       (failed & 47) = 0 as kept, failed::bigint as failed
from b
"""


@query
def op3_url_filter(spark, d):
    pages = table(spark, d, "pages")
    return urls.verdicts(urls.page_captures(pages), urls.page_lists(pages))


def _number(text, modulus):
    return f"(('0x' || substr(md5({text}), 1, 6))::bigint % {modulus})"


SQL["op3_url_filter"] = rf"""
with c as (
  select page_id, url, {_number("'f' || page_id", 366)} as day,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as h,
         rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/') as path
  from pages),
captures as (select row_number() over () as rid, page_id, url, day, rtrim(h, '.') as host, path from c),
patterns as (
  select distinct 'domain' as kind, host as pattern from captures where host is not null
  union select distinct 'prefix', host || regexp_extract(path, '^/[^/]+') from captures
  where host is not null and regexp_extract(path, '^/[^/]+') <> ''),
drawn as (
  select *, {_number("pattern", 366)} as added, {_number("'g' || pattern", 90)} + 1 as gone,
         {_number("'a' || pattern", 60)} + 1 as again, {_number("'k' || pattern", 9)} as what,
         case when kind = 'prefix' and {_number("'l' || pattern", 2)} = 0 then 'allow' else 'deny' end as list
  from patterns),
held as (
  select list, kind, pattern, added as since, case when what < 3 then 1000000 else added + gone end as until from drawn
  union all select list, kind, pattern, added + gone + again, 1000000 from drawn where what >= 7),
met as (
  select c.*, h.list, h.pattern, h.since
  from captures c join held h on h.kind = 'domain' and (c.host = h.pattern or ends_with(c.host, '.' || h.pattern))
    and c.day >= since and c.day < until
  union all
  select c.*, h.list, h.pattern, h.since
  from captures c join held h on h.kind = 'prefix'
    and (c.host || c.path = h.pattern or starts_with(c.host || c.path, h.pattern || '/'))
    and c.day >= since and c.day < until),
best as (
  select rid, count(*) as n,
         max(struct_pack(a := length(pattern), b := list = 'deny', c := pattern, d := since)) as m
  from met group by rid)
select page_id, url, day, host, coalesce(n, 0) as n_active, m.c as pattern, m.d as since,
       case when m.b then 'drop' else 'keep' end as verdict
from captures left join best using (rid)
"""


@query
def op4_line_dedup(spark, d):
    return lines.all_copies(table(spark, d, "documents"))


SQL["op4_line_dedup"] = r"""
with line as (
  select doc_id, unnest(range(len(l))) as line, unnest(l) as text
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
worded as (
  select distinct doc_id, line, w, array_to_string(w, ' ') as key
  from (select doc_id, line, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from line) where len(w) > 0),
texts as (
  select key, any_value(w) as w, min(struct_pack(doc_id, line)) as first,
         row_number() over (order by key) as id from worded group by key),
gaps as (
  select id, key as variant, 0 as place from texts where len(w) >= 5
  union all
  select id, array_to_string(w[1:i - 1] || w[i + 1:len(w)], ' '), i
  from (select id, w, unnest(range(1, len(w) + 1)) as i from texts where len(w) >= 5)),
near as (
  select a.id, b.id as other from gaps a join gaps b
  on a.variant = b.variant and a.id <> b.id and (a.place = b.place or a.place = 0 or b.place = 0)),
keeps as (
  select t.key, t.first, min(o.first) as near
  from texts t left join near n on n.id = t.id left join texts o on o.id = n.other group by t.key, t.first),
final as (select key, first, case when near < first then near else first end as keep from keeps)
select w.doc_id, w.line, keep.doc_id as first_doc, keep.line as first_line,
       case when keep = first then 0 else 1 end as distance
from worded w join final using (key) where struct_pack(w.doc_id, w.line) <> keep
"""


@query
def op5_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels").where(remainder(3) != 1))
    return quality.scores(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op6_mix_sources"] = r"""
with light as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from light group by source),
steps as (
  select *, source_size * 2 as cap,
         coalesce(sum(source_size * 2) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
         coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as used,
         sum(source_size) over ()::bigint * 1.5::double as budget, sum(weight) over ()::bigint as w
  from sources window o as (order by source_size * 2 / weight::double, source nulls last)),
levels as (select *, (budget - capped) / (w - used) as level from steps),
final as (
  select (select level from levels where cap > level * weight order by capped limit 1) as level),
targets as (
  select source, source_size,
         case when f.level is not null and cap > f.level * weight then f.level * weight else cap::double end as target
  from levels cross join final f),
plans as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
keys as (
  select source, key, sum(size)::bigint as sum from light group by source, key),
runs as (
  select k.source, key, sum,
         sum(sum) over (partition by k.source order by key rows between unbounded preceding and current row)::bigint
           - sum as run
  from keys k),
cuts as (
  select p.source, min(case when run + sum / 2 > target - whole * source_size then key end) as cut
  from runs r join plans p on r.source is not distinct from p.source group by p.source)
select l.doc_id, l.size, p.source_size, p.target,
       (l.size * (whole + case when cut is null or l.key < cut then 1 else 0 end))::bigint as taken
from light l join plans p on l.source is not distinct from p.source
join cuts c on l.source is not distinct from c.source
"""


@query
def op7_decontaminate(spark, d):
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op8_html_extraction(spark, d):
    pages = table(spark, d, "pages")
    return html.extract(pages, html.train(pages))


@query
def op9_shard_documents(spark, d):
    return sharding.assign(table(spark, d, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_jaccard_join(spark, d):
    return jaccard.groups(table(spark, d, "documents"))


SQL["op10_jaccard_join"] = r"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct rid, array_to_string(w[i:i + 4], ' ') as g
  from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
links as (
  select a.rid as a, b.rid as b
  from s a join s b on a.g = b.g and a.rid <> b.rid join n x on x.rid = a.rid join n y on y.rid = b.rid
  group by a.rid, b.rid, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (
  select rid as a, rid as b from n
  union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.low, d.doc_id) as component_id
from d left join n using (rid)
left join (select r.a as rid, min(e.doc_id) as low from reach r join d e on e.rid = r.b group by r.a) m using (rid)
"""


@query
def op11_tokenizer_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"))


@query
def op12_source_divergence(spark, d):
    return divergence.divergence(table(spark, d, "documents"))


SQL["op12_source_divergence"] = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
t as (select rid, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct rid) >= 30),
v as (select g.lang, count(k.term) as v from (select distinct lang from d) g left join kept k using (lang) group by g.lang),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept using (lang, term) group by all),
groups as (
  select g.lang, g.source, v.v, coalesce(sum(c.n), 0) as total
  from (select distinct lang, source from d) g join v using (lang) left join c using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v))::bigint as p
  from groups g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, (1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)))::bigint as q
  from c join (select lang, sum(total) as total, any_value(v) as v from groups group by lang) using (lang) group by lang, term),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
term as (
  select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value
  from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
      from (select * from pair union all select * from term))
where part = 'pair' or rank <= 50
"""


@query
def op13_bestfit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))
