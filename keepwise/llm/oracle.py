"""DuckDB SQL for the operators on documents and pages that SQL can express, written independently."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' '))) end as shingles from w
), one as (select doc_id, unnest(shingles) as shingle from s),
together as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from one a join one b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
  select a, b from together join s x on x.doc_id = a join s y on y.doc_id = b
  where 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)
), ways as (select a, b from links union all select b, a from links),
reach(id, other) as (
  select doc_id, doc_id from s union select id, b from reach join ways on a = other
), named as (select id, min(other) as component_id from reach group by id)
select doc_id, cast(len(shingles) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from s join named on id = doc_id
"""

REVISITS = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) // cast(2 ** (15 - 5 * (i % 4)) as bigint)) % 32) as bigint), 1)), '')
    as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to
from f
"""

REPEATED_PASSAGES = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
runs as (
  select doc_id, unnest(range(1, len(ws) - 18)) as p,
    unnest(list_transform(range(1, len(ws) - 18), lambda p: md5(array_to_string(ws[p:p + 19], ' ')))) as h
  from w where len(ws) >= 20
), later as (select doc_id, p from runs qualify row_number() over (partition by h order by doc_id, p) > 1),
gone as (select distinct doc_id, p + k as p from later cross join range(20) r(k)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (
  select words.doc_id, count(*) as n, count(gone.p) as lost, string_agg(word, ' ' order by words.p) filter (gone.p is null) as left_over
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id
)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(lost, 0) as bigint) as n_removed,
  sha256(coalesce(left_over, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""
