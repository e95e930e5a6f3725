import pytest
from pyspark.sql import functions as F

from triage.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, expected", [("", ""), (None, ""), ("  a\t", "a"), ("\x1b[31mred\x1b[0m", "red"), (" #x1B[1mx#x1B[0m ", "x"), ("\x1b[31m x ", " x")])
def test_clean_text(spark, value, expected):
    assert one(spark, value, T.clean_text) == expected


@pytest.mark.parametrize("value, expected", [("", "unknown.py"), (None, "unknown.py"), ("a.b.c", "a/b/c.py"), ("a\\b.py", "a/b.py"), ("/x//y/", "x/y.py"), ("x.py", "x/py.py"), ("tests/test_a.py", "tests/test_a.py"), ("mod", "mod.py")])
def test_python_filepath(spark, value, expected):
    assert one(spark, value, T.python_filepath) == expected


@pytest.mark.parametrize(
    "value, path, parts",
    [("a.py::C::f", "a.py", ["C", "f"]), ("C#m", "C", ["m"]), ("C#", "C", []), ("p.C.m", "p.C", ["m"]), ("m", "m", []), ("", "", []), (".m", ".m", []), ("m.", "m.", []), ("a::  :: b ", "a", ["b"]), ("x\\y::z", "x/y", ["z"])],
)
def test_split_name(spark, value, path, parts):
    got = one(spark, value, T.split_name)
    assert (got["path"], got["parts"]) == (path, parts)


@pytest.mark.parametrize(
    "value, lang, expected",
    [
        ("tests/a.py::T::f", "python", "tests/a.py::T::f"), ("pkg.mod.f", "python", "pkg/mod.py::f"), (None, "python", None), ("", "java", ""),
        ("com.acme.FooTest#bar", "java", "FooTest.java::FooTest::bar"), ("src/test/java/FooTest.java::bar", "java", "FooTest.java::FooTest::bar"), ("Acme.Tests.Calc.Add", "csharp", "Calc.cs::Calc::Add"),
        ("Foo", "java", "Foo.java"), ("src/test", "java", "test.java"), ("a.B.c", "ruby", "B::B::c"),
    ],
)
def test_normalize_test_name(spark, value, lang, expected):
    assert one(spark, value, lambda c: T.normalize_test_name(c, lang)) == expected


def test_parameters(spark):
    assert one(spark, "f[a](b)", T.strip_param_suffix) == "f"
    assert one(spark, "f(a){b}", T.strip_params) == "f(a)"


def test_locations(spark):
    message = 'C:\\w\\src\\A.cs(12,3): error\n  File "/home/u/tests/t.py", line 7\nat x.Y(C.java:9)\nlib/z.py:4'
    got = one(spark, message, T.locate)
    assert "src>A.cs>12" in got["heuristic"] and "tests>t.py>7" in got["heuristic"] and "lib>z.py>4" in got["heuristic"]
    assert "/home/u/tests/t.py:7" in got["raw_paths"]
    assert one(spark, None, T.locate)["heuristic"] == [] and one(spark, "", T.locate)["raw_paths"] == []


def test_tails_and_chains(spark):
    df = spark.createDataFrame([(["a>b>c>d>1", "x>b>c>d>1", "b>c>d>2"],)], "a array<string>")
    assert df.select(T.dedupe_by_tail(F.col("a"))).first()[0] == ["a>b>c>d>1", "b>c>d>2"]
    assert one(spark, "D:\\r\\app\\m.py", T.path_chain) == "app>m.py"
    assert one(spark, "/a//b::c/", T.chain_plain) == "a>b>c"


@pytest.mark.parametrize("given, error, expected", [("java.net.ConnectException", None, "Network"), ("", "ValueError: x", "ValueError"), (None, "oops", "oops"), (None, None, "Other"), (" ", " : x", "Other")])
def test_failure_type(spark, given, error, expected):
    df = spark.createDataFrame([(given, error)], "g string, e string")
    assert df.select(T.failure_type(F.col("g"), F.col("e"))).first()[0] == expected


def test_small_functions(spark):
    import hashlib

    assert one(spark, "a::b", T.stable_hash) == int(hashlib.md5(b"a::b").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert one(spark, "external::Add/2", T.external_simple_name) == "Add"
    assert one(spark, "<global>::F.cs::C::m", T.file_from_func_id) == "F.cs"
    assert one(spark, "\n".join("abc"), lambda c: T.snippet(c, 2)) == "a\nb\n    ..."
    assert tuple(one(spark, "com.acme.C#m", T.qualified_split)) == ("C", "m")
    assert tuple(one(spark, "m", T.qualified_split)) == ("UnknownClass", "m")
    assert tuple(one(spark, "tests/a.py::C::f[1]", lambda c: T.guess_target(c, "python"))) == ("C::f", "tests/a.py")
    assert [one(spark, f, T.keep_step) for f in ("a/venv/b.py", "ENV/x.py", "src/env.py", "", None)] == [False, False, True, True, True]
