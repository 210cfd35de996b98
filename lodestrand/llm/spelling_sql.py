"""SQL that gives the rows of ``spelling_variants.variants``: checksums bit by bit, near words as equal words with one place left open."""

from __future__ import annotations

#: The checksum is of a table of 256 values made by its rule.
SQL = """
with recursive bits(b, k, c) as (
  select b, 0, b::bigint from range(256) as t(b)
  union all select b, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8),
tab as (select list(c order by b) as tab from bits where k = 8),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
per_doc as (
  select doc_id, run, count(*) as n, hex(encode(concat(doc_id, ':', run))) as bytes from runs where length(run) >= 7 group by doc_id, run),
sums as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, length(bytes) // 2 + 1), lambda i: ('0x' || substr(bytes, 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) as h from per_doc, tab),
results as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from sums),
words as (select word, sum(n)::bigint as n from results where length(word) >= 7 group by word having sum(n) >= 2),
open as (
  select word, n, i, substr(word, 1, i) || ' ' || substr(word, i + 2) as hole, substr(word, 1, i) || substr(word, i + 2) as short
  from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word as x, b.word as y, b.n as m from open a join open b on a.hole = b.hole and a.word <> b.word
  union select o.word, w.word, w.n from open o join words w on o.short = w.word
  union select w.word, o.word, o.n from open o join words w on o.short = w.word),
near as (select x, count(*) as n_near, max(m) as best_n, arg_min(y, (-m, y)) as best from pairs group by x),
found as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 10 * n then best end as form, case when best_n >= 10 * n then best_n end as form_n
  from words left join near on x = word),
up(word, root, form) as (
  select word, word, form from found union all select u.word, f.word, f.form from up u join found f on f.word = u.form)
select f.word, f.n, f.n_near, f.form, f.form_n::bigint as form_n, u.root from found f join up u on u.word = f.word and u.form is null
"""
