"""Test cases from functions' own guards: signatures read with Python's grammar inside tasks, everything after that as columns.

A guard is an ``if`` that raises somewhere: what it compares a parameter with bounds the values that the function takes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import split_lines
from lodestrand.operators.code import module_of
from lodestrand.operators.planner import TOTALS, kind, usual_value

SIGNATURES = (
    "file string, function string, params array<struct<name: string, annotation: string, default: string>>, doc string, example struct<call: string, value: string>, returns string, "
    "raises array<string>, guards array<struct<name: string, low: string, open: boolean, none_raises: boolean>>, after int"
)
#: What an encoder is given, and a text that no parser takes.
PAYLOAD, GARBAGE = '{"sub": "alice"}', '"!!!garbage!!!"'
_EXAMPLE, _RAISES = re.compile(r">>>\s*(.+?)\s*\n\s*(.+)"), re.compile(r"\braises?\s+((?:\w+\.)*\w+)", re.I)
CASE = "struct<label: string, category: string, call: string, expectation: string, expected: string>"


class _Bounds(ast.NodeVisitor):
    """Intervals of names, from comparisons with numbers and None inside of ``if`` statements that raise."""

    def __init__(self):
        self.found: dict[str, dict] = {}

    def visit_If(self, node: ast.If) -> None:
        self.generic_visit(node)
        inner = list(ast.walk(node))
        if any(isinstance(n, ast.Raise) for n in inner):
            for test in inner:
                if isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and len(test.ops) == 1 and isinstance(test.comparators[0], ast.Constant):
                    self.bound(test.left.id, test.ops[0], test.comparators[0].value)

    def bound(self, name: str, sign: ast.cmpop, value) -> None:
        of = self.found.setdefault(name, {"low": None, "open": False, "none_raises": False})
        if isinstance(sign, ast.Is) and value is None:
            of["none_raises"] = True
        elif isinstance(value, (int, float)) and isinstance(sign, ast.Lt):
            of |= {"low": str(value), "open": False}
        elif isinstance(value, (int, float)) and isinstance(sign, ast.LtE) and of["low"] is None:
            of |= {"low": str(value), "open": True}


def _signature(file: str, node: ast.FunctionDef) -> dict:
    doc, bounds = ast.get_docstring(node) or "", _Bounds()
    for part in node.body:
        bounds.visit(part)
    raised = [n.exc.func if isinstance(n.exc, ast.Call) else n.exc for n in ast.walk(node) if isinstance(n, ast.Raise)]
    named = {n.id for n in raised if isinstance(n, ast.Name)} | {b for e in _RAISES.findall(doc) if (b := e.rsplit(".", 1)[-1])[:1].isupper()}
    example = _EXAMPLE.search(doc)
    args = node.args.args
    defaults = [None] * (len(args) - len(node.args.defaults)) + [ast.unparse(d) for d in node.args.defaults]
    first = node.body[0]
    documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    after = first.end_lineno if documented else first.lineno - 1
    return {
        "file": file, "function": node.name, "params": [{"name": a.arg, "annotation": ast.unparse(a.annotation) if a.annotation else "", "default": d} for a, d in zip(args, defaults, strict=True)],
        "doc": doc, "example": {"call": example[1].strip(), "value": example[2].strip()} if example else None, "returns": ast.unparse(node.returns) if node.returns else "", "raises": sorted(named),
        "guards": [{"name": n} | b for n, b in sorted(bounds.found.items()) if b["low"] is not None or b["none_raises"]], "after": after if first.lineno > node.lineno else None,
    }


def signatures(files: DataFrame) -> DataFrame:
    """A row for each function at the top of a Python file (path, language, content): parameters, docstring, its example, exceptions, guards.

    after: the line behind which statements can be put in first; null where the body stands on the line of ``def``.
    """
    pair = lambda *names: pa.struct([(n, pa.string()) for n in names])
    guard = pa.struct([("name", pa.string()), ("low", pa.string()), ("open", pa.bool_()), ("none_raises", pa.bool_())])
    kinds = (pa.string(), pa.string(), pa.list_(pair("name", "annotation", "default")), pa.string(), pair("call", "value"), pa.string(), pa.list_(pa.string()), pa.list_(guard), pa.int32())
    schema = pa.schema(list(zip(("file", "function", "params", "doc", "example", "returns", "raises", "guards", "after"), kinds, strict=True)))

    def functions(path: str, content: str | None) -> list[dict]:
        try:
            return [_signature(path, n) for n in ast.parse(content or "").body if isinstance(n, ast.FunctionDef)]
        except (SyntaxError, ValueError):
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([row for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in functions(path, content)], schema)

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, SIGNATURES)


def _case(label, category, call, expectation, expected=None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = ("label", "category", "call", "expectation", "expected")
    return F.struct(*[as_column(x).cast("string").alias(n) for x, n in zip((label, category, call, expectation, expected), names, strict=True)])


def _if(condition: Column, *cases: Column) -> Column:
    return F.when(condition, F.array(*cases)).otherwise(F.array().cast(f"array<{CASE}>"))


def with_cases(rows: DataFrame) -> DataFrame:
    """Adds ``counterpart`` (decode_x of encode_x and back, else null) and ``cases``, in order, to signatures.

    A function without parameters is called once.  Else: the docstring's example, the usual call, a round trip of encoders and decoders, and
    for each parameter what its kind and its guard call for.  Usual values are defaults or go by kind; a guard's least value
    is the usual one of a number, and what its encoder makes is that of a decoder's first parameter.
    """
    name = F.col("function")
    other = F.when(name.startswith("encode_"), F.concat(F.lit("decode_"), F.substring(name, F.lit(8), F.length(name)))).when(name.startswith("decode_"), F.concat(F.lit("encode_"), F.substring(name, F.lit(8), F.length(name))))
    rows = rows.withColumn("counterpart", other)
    decoder = name.startswith("decode_")
    made = F.concat("counterpart", F.lit(f"({PAYLOAD})"))

    def described(p: Column, i: Column) -> Column:
        of = F.get(F.filter("guards", lambda g: g["name"] == p["name"]), F.lit(0))
        low, what = F.when(~of["open"], of["low"]), kind(F.lower(p["name"]), F.lower(p["annotation"]), p["default"])
        usual = F.when(decoder & (i == 0), made).when((what == "numeric") & low.isNotNull(), low).otherwise(usual_value(what, p["default"]))
        return F.struct(p["name"].alias("name"), what.alias("kind"), usual.alias("usual"), low.cast("double").alias("low"), low.alias("least"), F.coalesce(of["none_raises"], F.lit(False)).alias("none_raises"))

    rows = rows.withColumn("described", F.transform("params", described))
    total = F.exists(F.array(*map(F.lit, TOTALS)), lambda w: F.contains(F.lower("function"), w)) | F.lower("doc").contains("total")
    usual = F.when(total, "ge_zero").otherwise("no_crash")

    def call(p: Column | None = None, value: Column | str = "") -> Column:
        given = lambda q: q["usual"] if p is None else F.when(q["name"] == p["name"], value).otherwise(q["usual"])
        return F.concat(name, F.lit("("), F.array_join(F.transform("described", lambda q: F.concat(q["name"], F.lit("="), given(q))), ", "), F.lit(")"))

    def of_parameter(p: Column) -> Column:
        label = lambda before, after="": F.concat(F.lit(before), p["name"], F.lit(after))
        is_ = lambda k: p["kind"] == k
        documented, low = F.size("raises") > 0, p["low"]
        bounded, free = is_("numeric") & low.isNotNull(), is_("numeric") & low.isNull()
        one = lambda before, category, value, expectation, after="": _case(label(before, after), category, call(p, F.lit(value) if isinstance(value, str) else value), expectation)
        return F.concat(
            _if(is_("iterable"), one("test_empty_", "empty", "[]", usual), one("test_large_", "large", '[{"price": 999999, "quantity": 100000}]', "no_crash")),
            _if(is_("rate"), one("test_zero_", "zero", "0", usual), one("test_boundary_", "boundary", "1", usual, "_full"), one("test_invalid_", "invalid", "1.5", "raises", "_above_one"), one("test_invalid_", "invalid", "-0.5", "raises", "_negative")),
            _if(is_("mapping"), one("test_empty_", "empty", "{}", "no_crash")),
            _if(is_("string") & documented, one("test_empty_", "invalid", '""', "raises"), one("test_invalid_", "invalid", GARBAGE, "raises", "_garbage")),
            _if(is_("string") & ~documented, one("test_empty_", "empty", '""', "no_crash")),
            _if(bounded, one("test_zero_", "zero", "0", F.when(low > 0, "raises").otherwise(usual)), one("test_negative_", "negative", "-1", F.when(low >= 0, "raises").otherwise(usual))),
            _if(bounded & (low > 0), one("test_boundary_", "boundary", p["least"], "no_crash")),
            _if(bounded & p["none_raises"], one("test_none_", "invalid", "None", "raises")),
            _if(free, one("test_zero_", "zero", "0", usual), one("test_negative_", "negative", "-1", usual)),
        )

    inner = F.regexp_extract(F.col("example.call"), r"(?s)^[^(]*\((.*)\)", 1)
    shown = F.col("example").isNotNull() & ~F.col("example.value").contains("...") & F.col("example.call").contains("(")
    first = F.get("described", F.lit(0))["usual"]
    trip = F.when(decoder, _case("test_roundtrip", "normal", F.concat(name, F.lit("("), made, F.lit(")")), "roundtrip_dict", PAYLOAD)).otherwise(_case("test_roundtrip", "normal", F.concat("counterpart", F.lit("("), name, F.lit("("), first, F.lit("))")), "roundtrip", first))
    cases = F.concat(
        _if(shown, _case("test_docstring_example", "normal", F.concat(name, F.lit("("), inner, F.lit(")")), "exact", F.col("example.value"))),
        F.array(_case("test_normal", "normal", call(), usual)), _if(F.col("counterpart").isNotNull(), trip), F.flatten(F.transform("described", of_parameter)),
    )
    smoke = F.array(_case(F.concat(F.lit("test_"), name, F.lit("_smoke")), "normal", F.concat(name, F.lit("()")), "no_crash"))
    return rows.withColumn("cases", F.when(F.size("params") == 0, smoke).otherwise(cases)).drop("described")


def cases(rows: DataFrame) -> DataFrame:
    """(file, function, ord, label, category, call, expectation, expected) of signatures."""
    return with_cases(rows).select("file", "function", F.posexplode("cases").alias("ord", "c")).select("file", "function", "ord", "c.*")


def modules(rows: DataFrame) -> DataFrame:
    """(file, function, text): a module of tests for each function; the other half of a round trip is imported where the repository has it."""
    cased = with_cases(rows)
    have = rows.groupBy(F.col("function").alias("counterpart")).agg(F.min("file").alias("at"), F.collect_set("file").alias("all_files"))  # a name's definitions
    cased = cased.join(have, "counterpart", "left")
    lines = lambda *parts: F.concat_ws("\n", *parts)
    source = lambda file: module_of(file)
    other = F.when(F.array_contains("all_files", F.col("file")), F.col("file")).otherwise(F.col("at"))
    needs = F.exists("cases", lambda c: c["expectation"].startswith("roundtrip")) & other.isNotNull()
    quoted = lambda e: F.when(e.rlike("^['\"]|^-?[0-9]"), e).otherwise(F.concat(F.lit('"'), e, F.lit('"')))

    def test(c: Column) -> Column:
        is_ = lambda e: c["expectation"] == e
        body = (
            F.when(is_("raises"), lines(F.lit("    with pytest.raises((ValueError, TypeError)):"), F.concat(F.lit("        "), c["call"])))
            .when(is_("ge_zero"), lines(F.concat(F.lit("    result = "), c["call"]), F.lit('    assert result >= 0, f"expected non-negative total, got {result!r}"')))
            .when(is_("roundtrip"), lines(F.concat(F.lit("    rebuilt = "), c["call"]), F.lit("    assert rebuilt")))
            .when(is_("roundtrip_dict"), lines(F.concat(F.lit("    rebuilt = "), c["call"]), F.concat(F.lit("    for k, v in "), c["expected"], F.lit(".items():")), F.lit("        assert rebuilt[k] == v")))
            .when(is_("exact"), F.concat(F.lit("    assert "), c["call"], F.lit(" == "), quoted(c["expected"])))
            .otherwise(F.concat(F.lit("    "), c["call"]))
        )
        return F.concat(F.lit("\n\ndef "), c["label"], F.lit("():\n"), body)

    categories = F.array_join(F.array_sort(F.array_distinct(F.transform("cases", lambda c: c["category"]))), ", ")
    head = lines(
        F.concat(F.lit('"""Tests of '), "function", F.lit(": "), categories, F.lit('."""')), F.lit("import pytest"), F.lit(""), F.concat(F.lit("from "), source(F.col("file")), F.lit(" import "), "function"),
        F.when(needs, F.concat(F.lit("from "), module_of(other), F.lit(" import "), "counterpart")),
    )
    return cased.select("file", "function", F.concat(head, F.lit("\n"), F.array_join(F.transform("cases", test), "\n"), F.lit("\n")).alias("text"))


def guard_edits(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """(file, after, text): guards of rates that the labels of ``failed`` (function, label) name because nothing was raised."""
    rates = F.filter("params", lambda p: kind(F.lower(p["name"]), F.lower(p["annotation"]), p["default"]) == "rate")
    missing = failed.groupBy("function").agg(F.collect_set("label").alias("labels"))
    each = rows.where("after is not null").select("file", "function", "after", F.posexplode(F.transform(rates, lambda p: p["name"])).alias("ord", "name")).join(missing, "function")
    each = each.where(F.exists("labels", lambda label: F.contains(label, F.col("name"))))
    text = F.concat(F.lit("    if not 0 <= "), "name", F.lit(' <= 1:\n        raise ValueError("'), "name", F.lit(' must be between 0 and 1")'))
    found = each.groupBy("file", "after", "function").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("x"))
    return found.select("file", "after", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (path, content, ...) with each edit's (file, after, text) put in behind its line, in one pass over the lines."""
    per_file = edits.groupBy(F.col("file").alias("path"), "after").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    maps = per_file.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("after", "text"))).alias("edits"))
    lines = F.transform(split_lines(F.col("content")), lambda line, i: F.concat_ws("\n", line, F.try_element_at("edits", i + 1)))
    first = F.try_element_at("edits", F.lit(0))
    end = F.when(F.col("content").endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    put_in = F.concat(F.concat_ws("\n", first, F.array_join(lines, "\n")), end)
    return files.join(maps, "path", "left").withColumn("content", F.when(F.col("edits").isNotNull(), put_in).otherwise(F.col("content"))).drop("edits")
