"""Signatures, cases per rule, rendered modules and edits of sources."""

import ast

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import testgen as G

SOURCE = '''
import os

def total_cart(items: list[int], discount=0.1, quantity: int = 3) -> float:
    """Total of a cart.

    >>> total_cart([1, 2], 0)
    9
    """
    if quantity < 2:
        raise ValueError("quantity")
    if quantity is None:
        raise TypeError
    return sum(items)

def encode_token(
    claims,
    key="a, b",
):
    return str(claims)

def decode_token(token: str, ttl: int = 5):
    """Reads a token. Raises app.errors.TokenError when it is bad.

    >>> decode_token("eyJ...")
    {...}
    """
    return token

def page(limit, offset: int, note, opts: dict, x, y=(1, 2)):
    if limit < 0:
        if opts:
            raise KeyError(limit)
    if offset <= 0:
        raise ValueError
    if x < 5:
        return 1

def smoke(): return 1

async def later(a):
    if a < 1:
        raise ValueError

class K:
    def method(self, rate):
        return rate
'''


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([("app/m.py", "python", SOURCE), ("bad.py", "python", "def ("), ("x.js", "javascript", "function a() {}"), ("empty.py", "python", None)], "path string, language string, content string")
    return files, G.signatures(files).cache()


def test_signatures(rows):
    got = {r.function: r for r in rows[1].collect()}
    assert set(got) == {"total_cart", "encode_token", "decode_token", "page", "smoke"}
    cart = got["total_cart"]
    assert [(p.name, p.annotation, p.default) for p in cart.params] == [("items", "list[int]", None), ("discount", "", "0.1"), ("quantity", "int", "3")]
    assert (cart.example.call, cart.example.value, cart.returns, cart.raises) == ("total_cart([1, 2], 0)", "9", "float", ["TypeError", "ValueError"])
    assert [(g.name, g.low, g.open, g.none_raises) for g in cart.guards] == [("quantity", "2", False, True)]
    assert got["decode_token"].raises == ["TokenError"] and not got["decode_token"].guards
    assert [(g.name, g.low, g.open) for g in got["page"].guards] == [("limit", "0", False), ("offset", "0", True)]  # x < 5 raises nothing
    assert got["smoke"].after is None and got["encode_token"].params[1].default == "'a, b'"


def test_cases_per_rule(rows):
    got = {}
    for r in G.cases(rows[1]).orderBy("function", "ord").collect():
        got.setdefault(r.function, []).append((r.label, r.category, r.call, r.expectation, r.expected))
    assert got["smoke"] == [("test_smoke_smoke", "normal", "smoke()", "no_crash", None)]
    usual = 'items=[{"price": 10, "quantity": 2}], discount=0.1, quantity=2'
    cart = got["total_cart"]
    assert cart[:2] == [("test_docstring_example", "normal", "total_cart([1, 2], 0)", "exact", "9"), ("test_normal", "normal", f"total_cart({usual})", "ge_zero", None)]
    assert [c[0] for c in cart[2:]] == [
        "test_empty_items", "test_large_items", "test_zero_discount", "test_boundary_discount_full", "test_invalid_discount_above_one", "test_invalid_discount_negative", "test_zero_quantity", "test_negative_quantity", "test_boundary_quantity", "test_none_quantity",
    ]
    by = {c[0]: c for c in cart}
    assert by["test_zero_quantity"][3] == by["test_negative_quantity"][3] == by["test_none_quantity"][3] == "raises" and by["test_boundary_quantity"][2].endswith("quantity=2)")
    assert by["test_zero_discount"][3] == "ge_zero" and by["test_large_items"][3] == "no_crash" and by["test_invalid_discount_above_one"][3] == "raises"
    assert ("test_roundtrip", "normal", 'decode_token(encode_token({"sub": "alice"}))', "roundtrip", '{"sub": "alice"}') in got["encode_token"]
    decode = {c[0]: c for c in got["decode_token"]}
    assert "test_docstring_example" not in decode  # its value is left open
    assert decode["test_roundtrip"][2:] == ('decode_token(encode_token({"sub": "alice"}))', "roundtrip_dict", '{"sub": "alice"}')
    assert decode["test_normal"][2] == 'decode_token(token=encode_token({"sub": "alice"}), ttl=5)'
    assert decode["test_empty_token"][1:4:2] == ("invalid", "raises") and decode["test_invalid_token_garbage"][2] == 'decode_token(token="!!!garbage!!!", ttl=5)'
    page = {c[0]: c for c in got["page"]}
    assert page["test_zero_limit"][3] == "no_crash" and page["test_negative_limit"][3] == "raises" and "test_boundary_limit" not in page
    assert page["test_zero_offset"][3] == page["test_negative_offset"][3] == "no_crash"  # an open bound isn't tested at its edge
    assert "test_empty_opts" in page and not any(c.endswith("_x") or c.endswith("_y") for c in page)


def test_modules_parse_and_import_the_other_half(rows):
    found = {r.function: r.text for r in G.modules(rows[1]).collect()}
    for text in found.values():
        ast.parse(text)
    assert "from app.m import decode_token\nfrom app.m import encode_token\n" in found["decode_token"] and "from app.m import decode_token" in found["encode_token"]
    assert found["total_cart"].count("def test_") == 12 and "import encode" not in found["total_cart"]


def test_edits(spark, rows):
    files, signatures = rows
    failed = spark.createDataFrame([("total_cart", "test_invalid_discount_negative"), ("smoke", "test_smoke_smoke"), ("encode_token", "test_other")], "function string, label string")
    edits = G.guard_edits(signatures, failed)
    out = {r.path: r.content for r in G.edited(files, edits).collect()}
    assert out["bad.py"] == "def (" and out["empty.py"] is None and out["x.js"] == "function a() {}"
    tree = ast.parse(out["app/m.py"])
    cart = next(n for n in tree.body if getattr(n, "name", "") == "total_cart")
    assert ast.get_docstring(cart).startswith("Total of a cart.") and ast.unparse(cart.body[1]).startswith("if not 0 <= discount <= 1:")
    assert out["app/m.py"].replace('    if not 0 <= discount <= 1:\n        raise ValueError("discount must be between 0 and 1")\n', "") == SOURCE
    many = spark.createDataFrame([("x.js", 0, "// first"), ("x.js", 1, "// b"), ("x.js", 1, "// a")], "file string, after int, text string")
    assert {r.path: r.content for r in G.edited(files, many).collect()}["x.js"] == "// first\nfunction a() {}\n// a\n// b"
    assert G.edited(files, edits.where(F.lit(False))).where("path = 'app/m.py'").first().content == SOURCE
