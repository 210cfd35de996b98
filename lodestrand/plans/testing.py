"""Test cases, modules and guards for functions with guards of their own, a file of Python for each row of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import testgen as G
from lodestrand.operators.shared import written
from lodestrand.sources.tables import table

QUERIES, SQL = {}, {}
#: Lines of the file of part k with size s; null lines are left out.
_LINES = {
    0: [
        "concat('def total_', k, '(items: list, discount=0.05, quantity: int = 1):')", "'    \"\"\"Sum of a cart.'", "''", "concat('    >>> total_', k, '([], 0, ', s, ')')", "case when k % 5 = 0 then '    ...' else concat('    ', s) end", "'    \"\"\"'",
        "case when k % 3 = 0 then concat('    if quantity < ', s % 3, ':') end", "case when k % 3 = 0 then '        raise ValueError(\"quantity\")' end", "'    return sum(items) * quantity'",
    ],
    1: [
        "concat('def encode_', k, '(payload):')", "'    return str(payload)'", "''", "''", "concat('def decode_', k, '(token: str, limit=5):')", "'    \"\"\"Raises ValueError on bad tokens.\"\"\"'",
        "'    if limit is None or limit < 1:'", "'        raise TypeError(\"limit\")'", "'    return token'",
    ],
    2: ["concat('def page_', k, '(limit: int, name: str, offset=0, *, deep=False):')", "'    if limit < 0:'", "'        if deep:'", "'            raise ValueError'", "'    while offset <= 0:'", "'        offset += 1'", "'    return name'"],
    3: ["concat('def smoke_', k, '():')", "concat('    return ', k)"],
}
_CONTENT = "case k % 4 " + " ".join(f"when {i} then concat_ws(chr(10), {', '.join(lines)})" for i, lines in _LINES.items()) + " end"
_PATH = "concat('shop/part_', k, '.py')"
SOURCES = f"sources as (select k, s, {_PATH} as file, {_CONTENT} as content from (select p_partkey as k, p_size as s from part))"
#: The same functions as a table of parameters.
PARAMS = """params as (
  select k, file, concat('total_', k) as function, unnest([{'ord': 0, 'name': 'items', 'kind': 'iterable', 'usual': '[{"price": 10, "quantity": 2}]', 'low': null::int, 'none': false}, {'ord': 1, 'name': 'discount', 'kind': 'rate', 'usual': '0.05', 'low': null, 'none': false},
    {'ord': 2, 'name': 'quantity', 'kind': 'numeric', 'usual': case when k % 3 = 0 then (s % 3)::varchar else '1' end, 'low': case when k % 3 = 0 then s % 3 end, 'none': false}]) as p from sources where k % 4 = 0
  union all select k, file, concat('encode_', k), {'ord': 0, 'name': 'payload', 'kind': 'mapping', 'usual': '{"sub": "alice"}', 'low': null, 'none': false} from sources where k % 4 = 1
  union all select k, file, concat('decode_', k), unnest([{'ord': 0, 'name': 'token', 'kind': 'string', 'usual': concat('encode_', k, '({"sub": "alice"})'), 'low': null, 'none': false}, {'ord': 1, 'name': 'limit', 'kind': 'numeric', 'usual': '1', 'low': 1, 'none': true}]) from sources where k % 4 = 1
  union all select k, file, concat('page_', k), unnest([{'ord': 0, 'name': 'limit', 'kind': 'numeric', 'usual': '0', 'low': 0, 'none': false}, {'ord': 1, 'name': 'name', 'kind': 'string', 'usual': '"sample-value-123"', 'low': null, 'none': false}, {'ord': 2, 'name': 'offset', 'kind': 'numeric', 'usual': '0', 'low': null, 'none': false}]) from sources where k % 4 = 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sources(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size as s")
    return parts.selectExpr(f"{_PATH} as path", "'python' as language", f"{_CONTENT} as content")


def signatures(spark, sf_dir):
    return written(G.signatures(sources(spark, sf_dir)))


@query(
    f"""with {SOURCES}, {PARAMS} select file, function, p.name as name, p.low::varchar as low, case when p.low is not null then false end as open, p.none as none_raises,
case when starts_with(function, 'decode') then 'TypeError ValueError' when starts_with(function, 'page') or k % 12 = 0 then 'ValueError' else '' end as raises from params"""
)
def n5_signature_guards(spark, sf_dir):
    """Parameters with the bounds that guards give them, and the exceptions of their functions."""
    rows = signatures(spark, sf_dir).select("file", "function", F.explode("params.name").alias("name"), "guards", F.array_join("raises", " ").alias("raises"))
    of = F.get(F.filter("guards", lambda g: g["name"] == F.col("name")), F.lit(0))
    return rows.select("file", "function", "name", of["low"].alias("low"), of["open"].alias("open"), F.coalesce(of["none_raises"], F.lit(False)).alias("none_raises"), "raises")


_CASES = f"""with {SOURCES}, {PARAMS}, q as (select *, case when starts_with(function, 'total') then 'ge_zero' else 'no_crash' end as fine, starts_with(function, 'decode') or starts_with(function, 'page') as documented from params),
f as (select file, function, any_value(fine) as fine, any_value(k) as k, list(p.name order by p.ord) as names, list(p.usual order by p.ord) as usuals from q group by file, function),
t as (
  select file, function, p, 0 as i, concat('test_empty_', p.name) as label, 'empty' as category, '[]' as value, fine as expectation from q where p.kind = 'iterable'
  union all select file, function, p, 1, concat('test_large_', p.name), 'large', '[{{"price": 999999, "quantity": 100000}}]', 'no_crash' from q where p.kind = 'iterable'
  union all select file, function, p, 0, concat('test_zero_', p.name), 'zero', '0', fine from q where p.kind = 'rate'
  union all select file, function, p, 1, concat('test_boundary_', p.name, '_full'), 'boundary', '1', fine from q where p.kind = 'rate'
  union all select file, function, p, 2, concat('test_invalid_', p.name, '_above_one'), 'invalid', '1.5', 'raises' from q where p.kind = 'rate'
  union all select file, function, p, 3, concat('test_invalid_', p.name, '_negative'), 'invalid', '-0.5', 'raises' from q where p.kind = 'rate'
  union all select file, function, p, 0, concat('test_empty_', p.name), 'empty', '{{}}', 'no_crash' from q where p.kind = 'mapping'
  union all select file, function, p, 0, concat('test_empty_', p.name), case when documented then 'invalid' else 'empty' end, '""', case when documented then 'raises' else 'no_crash' end from q where p.kind = 'string'
  union all select file, function, p, 1, concat('test_invalid_', p.name, '_garbage'), 'invalid', '"!!!garbage!!!"', 'raises' from q where p.kind = 'string' and documented
  union all select file, function, p, 0, concat('test_zero_', p.name), 'zero', '0', case when p.low > 0 then 'raises' else fine end from q where p.kind = 'numeric'
  union all select file, function, p, 1, concat('test_negative_', p.name), 'negative', '-1', case when p.low >= 0 then 'raises' else fine end from q where p.kind = 'numeric'
  union all select file, function, p, 2, concat('test_boundary_', p.name), 'boundary', p.low::varchar, 'no_crash' from q where p.kind = 'numeric' and p.low > 0
  union all select file, function, p, 3, concat('test_none_', p.name), 'invalid', 'None', 'raises' from q where p.kind = 'numeric' and p.none),
c as (
  select file, function, -3 as a, 0 as i, 'test_docstring_example' as label, 'normal' as category, concat(function, '([], 0, ', s, ')') as call, 'exact' as expectation, s::varchar as expected from f join sources using (file, k) where k % 4 = 0 and k % 5 <> 0
  union all select file, function, -2, 0, 'test_normal', 'normal', concat(function, '(', array_to_string(list_transform(range(1, len(names) + 1), lambda x: concat(names[x], '=', usuals[x])), ', '), ')'), fine, null from f
  union all select file, function, -1, 0, 'test_roundtrip', 'normal', concat('decode_', k, '(encode_', k, '({{"sub": "alice"}}))'), case when starts_with(function, 'encode') then 'roundtrip' else 'roundtrip_dict' end, '{{"sub": "alice"}}' from f where k % 4 = 1
  union all select t.file, t.function, p.ord, i, label, category, concat(t.function, '(', array_to_string(list_transform(range(1, len(names) + 1), lambda x: concat(names[x], '=', case when names[x] = p.name then value else usuals[x] end)), ', '), ')'), expectation, null from t join f using (file, function)
  union all select file, concat('smoke_', k), 0, 0, concat('test_smoke_', k, '_smoke'), 'normal', concat('smoke_', k, '()'), 'no_crash', null from sources where k % 4 = 3),
cases as (select file, function, (row_number() over (partition by file, function order by a, i) - 1)::int as ord, label, category, call, expectation, expected from c)"""


@query(f"{_CASES} select * from cases")
def p2_guarded_cases(spark, sf_dir):
    """Cases that guards, docstrings and encoders call for."""
    return G.cases(signatures(spark, sf_dir))


@query(
    rf"""{_CASES}, tests as (select file, function, ord, category, expectation, concat(chr(10), chr(10), 'def ', label, '():', chr(10), case expectation
  when 'raises' then concat('    with pytest.raises((ValueError, TypeError)):', chr(10), '        ', call) when 'ge_zero' then concat('    result = ', call, chr(10), '    assert result >= 0, f"expected non-negative total, got {{result!r}}"')
  when 'roundtrip' then concat('    rebuilt = ', call, chr(10), '    assert rebuilt') when 'roundtrip_dict' then concat('    rebuilt = ', call, chr(10), '    for k, v in ', expected, '.items():', chr(10), '        assert rebuilt[k] == v')
  when 'exact' then concat('    assert ', call, ' == ', expected) else concat('    ', call) end) as text from cases),
m as (select file, function, string_agg(distinct category, ', ' order by category) as said, bool_or(starts_with(expectation, 'roundtrip')) as trip, string_agg(text, chr(10) order by ord) as body from tests group by all),
s as (select *, concat('shop.part_', k) as module from m join (select k, file from sources) using (file))
select file, function, md5(concat_ws(chr(10), concat('\"\"\"Tests of ', function, ': ', said, '.\"\"\"'), 'import pytest', '', concat('from ', module, ' import ', function),
  case when trip then concat('from ', module, ' import ', case when starts_with(function, 'encode') then 'decode_' else 'encode_' end, k) end) || chr(10) || body || chr(10)) as text_md5 from s""".replace('\\"', '"')
)
def p3_test_modules(spark, sf_dir):
    """The modules of tests that the cases make."""
    return G.modules(signatures(spark, sf_dir)).select("file", "function", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_GUARD = "concat('    if not 0 <= discount <= 1:', chr(10), '        raise ValueError(\"discount must be between 0 and 1\")')"


@query(f"with {SOURCES} select file, md5(case when k % 8 = 0 then replace(content, concat(chr(10), '    \"\"\"', chr(10)), concat(chr(10), '    \"\"\"', chr(10), {_GUARD}, chr(10))) else content end) as content_md5 from sources")
def p6_patched_sources(spark, sf_dir):
    """Every other function of totals failed to reject a discount; its source with the guard put in."""
    files = sources(spark, sf_dir)
    rows = written(G.signatures(files))
    failed = G.cases(rows).where("label like 'test_invalid_%' and function like 'total_%' and cast(split(function, '_')[1] as long) % 8 = 0").select("function", "label")
    return G.edited(files, G.guard_edits(rows, failed)).select(F.col("path").alias("file"), F.md5(F.col("content").cast("binary")).alias("content_md5"))
