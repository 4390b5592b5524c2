"""SQL twins of the registered queries, where DuckDB can express them."""

from __future__ import annotations

from .license import LICENCE_FILE, TERM, template_terms

ORACLES: dict[str, str] = {}

ORACLES["op3_quality"] = r"""
with words as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
         row_number() over () as r
  from documents),
grams as (
  select r, j, array_to_string(w[j:j + 7], ' ') as g
  from words, range(1, len(w) - 6) t(j)),
met as (select r, j, count(*) over (partition by r, g) as n from grams),
covered as (
  select r, sum(least(8, coalesce(nxt - j, 8))) as n
  from (select r, j, lead(j) over (partition by r order by j) as nxt from met where n > 1) group by r),
base as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from words left join covered c using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_symbols > 0.25 * n_words) and not (n_lines >= 4 and n_dup_lines > 0.3 * n_lines)
       and not (word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from judged
"""

ORACLES["op9_search"] = r"""
with words as (
  select doc_id, unnest(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+')) as t
  from documents where doc_id is not null and text is not null),
tf as (select doc_id, t, count(*) as tf from words where t <> '' group by 1, 2),
lengths as (select doc_id, sum(tf) as dl from tf group by 1),
facts as (select (select count(*) from documents where doc_id is not null) as n, (select sum(tf) from tf) as words),
idf as (select t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, facts group by t, n),
scored as (
  select q.doc_id as query_id, d.doc_id,
         round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / (words / n)))), 6) as score
  from tf q join idf using (t) join tf d using (t) join lengths l on l.doc_id = d.doc_id, facts
  where q.doc_id % 50 = 0 group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
select query_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""

_TEMPLATE_ROWS = ", ".join(f"('{licence}', {i}, '{term}', {n})" for licence, i, term, n in template_terms())

ORACLES["op6_license"] = rf"""
with template(licence, i, term, n) as (values {_TEMPLATE_ROWS}),
known as (select distinct term from template),
files as (
  select doc_id, concat_ws('/', source, doc_id // 1000, doc_id // 100, case when doc_id % 100 = 0 then 'LICENSE' else doc_id || '.txt' end) as path,
         coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from files),
terms as (select doc_id, line_no, unnest(regexp_extract_all(lower(line), '{TERM}')) as term from lines),
tf as (select doc_id, line_no, term, count(*) as tf from terms group by all),
df as (select term, count(distinct doc_id) as df from tf join known using (term) group by 1),
idf as (select term, ln((1 + (select count(*) from files)) / (1 + coalesce(df, 0))) + 1 as idf from known left join df using (term)),
norms as (
  select doc_id, line_no, sqrt(sum(case when idf is null then power(ln(1 + (select count(*) from files)) + 1, 2) else power(tf * idf, 2) end)) as norm
  from tf left join idf using (term) group by 1, 2),
vectors as (select licence, i, term, n * idf as w from template join idf using (term)),
lengths as (select licence, i, sqrt(sum(w * w)) as length from vectors group by 1, 2),
cosines as (
  select doc_id, line_no, licence, round(sum(tf * idf * w) / any_value(length) / any_value(norm), 6) as cosine
  from tf join vectors using (term) join idf using (term) join lengths using (licence, i) join norms using (doc_id, line_no)
  group by doc_id, line_no, licence, i having cosine >= 0.8),
best as (select doc_id, first(licence order by cosine desc, line_no, licence desc) as own, max(cosine) as own_cosine from cosines group by 1),
own as (select f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') as leaf, own, own_cosine from files f left join best using (doc_id)),
holders as (
  select leaf as dir, min(path) as h_path, first(own order by path) as h_own, first(own_cosine order by path) as h_cosine
  from own where own is not null and regexp_matches(path, '{LICENCE_FILE}') group by 1),
above as (
  select o.doc_id, first(h_path order by length(dir) desc) as h_path, first(h_own order by length(dir) desc) as h_own,
         first(h_cosine order by length(dir) desc) as h_cosine
  from own o join holders on dir = '' or o.leaf = dir or starts_with(o.leaf, dir || '/') where o.own is null group by 1)
select doc_id, path, coalesce(own, h_own) as licence, coalesce(own_cosine, h_cosine) as cosine,
       case when own is not null then 'own' when h_own is not null then 'inherited' else 'none' end as source,
       case when own is not null then path else h_path end as licence_path
from own left join above using (doc_id)
"""

ORACLES["op12_mixing"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
sources as (
  select source, sum(size) as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source),
ranked as (
  select *, sum(2 * source_size) over filling - 2 * source_size as full_words, sum(weight) over () - sum(weight) over filling + weight as left_weight
  from sources window filling as (order by source_size / weight, source nulls last rows unbounded preceding)),
shares as (
  select first((1.5::double * (select sum(source_size) from sources) - full_words) / left_weight order by source_size / weight, source nulls last) as a_weight
  from ranked where (1.5::double * (select sum(source_size) from sources) - full_words) / left_weight * weight < 2 * source_size),
targets as (
  select source, source_size, least(2.0::double * source_size, coalesce(a_weight, 0)::double * weight) as target from sources, shares),
placed as (
  select doc_id, size, source_size, target, least(round(target), 2 * source_size) as wanted,
         sum(size) over (partition by s.source order by key, doc_id nulls first rows unbounded preceding) - size as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(case when source_size = 0 then 0 else
         floor(wanted / source_size) * size
         + greatest(0, least(start + size, wanted - floor(wanted / source_size) * source_size) - start) end as bigint) as taken
from placed
"""
