"""The SQL (DuckDB) that gives the rows of the URL filter's query."""

from __future__ import annotations

from lodestrand.llm.url_templates import LEAST_LABELS, LEAST_PAGES, PRIOR_WEIGHT, RARE, REJECT_PERCENT


#: Levels that the SQL has; the given urls have far fewer segments.
DEPTH = 9


def _says(rules: list[tuple[str, str, str]], what: int) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    show = lambda r: f"'{r[0]}{r[1]}'" if what == 0 else f"'{r[2]}'"
    return "case " + " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then {show((h, p, v))}" for h, p, v in ordered) + " end"


def sql(rules: list[tuple[str, str, str]]) -> str:
    """The whole query; each level of the tree is a chain of common table expressions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = [
        rf"""with read as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
counted as (select host, path, count(*) as n, {_says(rules, 1)} as says from read group by host, path),
parts as (select *, string_split(regexp_replace(path, '^/', ''), '/') as p from counted),
p0 as (
  select host, path, n, case when says is not null then n else 0 end as labelled, case when says = 'block' then n else 0 end as bad,
    p as segments, '' as template, false as closed from parts)"""
    ]
    for d in range(DEPTH):
        out.append(
            rf"""
a{d} as (select *, segments[{d + 1}] as segment from p{d} where len(segments) > {d} and not closed),
s{d} as (select host, template, segment, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from a{d} group by all),
z{d} as (select host, template, sum(n) as node_n from s{d} group by all),
c{d} as (
  select s.*, node_n < {LEAST_PAGES} as few, case when segment <> '' and (n < {LEAST_PAGES} or n * {RARE} < node_n) then '*' || regexp_extract(segment, '\.[A-Za-z]+$', 0) else segment end as branch
  from s{d} s join z{d} z on s.host = z.host and s.template = z.template),
b{d} as (select host, template, branch, sum(labelled)::double as labelled, sum(bad)::double as bad from c{d} group by all),
o{d} as (select host, template, sum(labelled) as all_l, sum(bad) as all_b from b{d} group by all),
k{d} as (
  select b.*, case when pow((bad * all_l - all_b * labelled) * (all_l + 2), 2) <= 4 * (all_b + 1) * (all_l - all_b + 1) * labelled * all_l * all_l then 'alike' else 'own ' || branch end as kind
  from b{d} b join o{d} o on b.host = o.host and b.template = o.template),
m{d} as (
  select *, case when count(*) over (partition by host, template, kind) > 1 and kind = 'alike' then '(alike)' else branch end as merged from k{d}),
n{d} as (select c.host, c.template, segment, few, case when few then '**' else merged end as merged from c{d} c join m{d} m on c.host = m.host and c.template = m.template and c.branch = m.branch),
p{d + 1} as (
  select host, path, n, labelled, bad, segments, template, closed from p{d} where len(segments) <= {d} or closed
  union all
  select a.host, path, n, labelled, bad, segments, a.template || '/' || merged, few from a{d} a join n{d} x on a.host = x.host and a.template = x.template and a.segment = x.segment)"""
        )
    last = f"p{DEPTH}"
    out.append(
        rf"""
total as (select coalesce(sum(labelled), 0) as all_l, coalesce(sum(bad), 0) as all_b from {last}),
rejected as (
  select host, template from (select host, template, sum(labelled) as labelled, sum(bad) as bad from {last} group by all), total
  where labelled >= {LEAST_LABELS} and 100 * (bad * all_l + {PRIOR_WEIGHT} * all_b) >= {REJECT_PERCENT} * (labelled + {PRIOR_WEIGHT}) * all_l),
found as (
  select read.*, template, {_says(rules, 0).replace("host", "read.host").replace("path", "read.path")} as rule, {_says(rules, 1).replace("host", "read.host").replace("path", "read.path")} as says
  from read join {last} p on read.host = p.host and read.path = p.path)
select page_id, found.host, path, rule, coalesce(says, case when r.host is not null then 'block' else 'allow' end) as verdict, found.template
from found left join rejected r on found.host = r.host and found.template = r.template"""
    )
    return ",".join(out)
