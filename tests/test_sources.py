import json

from pyspark.sql import functions as F

from triage.operators import extract as X
from triage.operators import callgraph as C
from triage.operators import tagging as G
from triage.sources import results as I


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


JUNIT = """<testsuites><testsuite><testcase classname="pkg.T" name="ok"/><testcase classname="pkg.T" name="fail"><failure message="AssertionError: 1">trace</failure></testcase>
<testcase classname="pkg.T" name="sk"><skipped message="later"/></testcase></testsuite></testsuites>"""
NUNIT = """<test-run><test-suite><test-case fullname="NS.Foo.Bar" result="Failed"><failure><message>bad</message></failure></test-case><test-case classname="NS.Foo" name="Skip" result="Skipped"/></test-suite></test-run>"""
TRX = """<t:TestRun xmlns:t="http://x"><t:TestDefinitions><t:UnitTest id="1"><t:TestMethod className="NS.Calc" name="Add"/></t:UnitTest></t:TestDefinitions><t:Results>
<t:UnitTestResult testId="1" testName="Add" outcome="Failed"><t:Output><t:ErrorInfo><t:Message>boom</t:Message></t:ErrorInfo></t:Output></t:UnitTestResult><t:UnitTestResult testId="2" testName="Other" outcome="Timeout"/></t:Results></t:TestRun>"""
XUNIT = """<assemblies><assembly><collection><test name="A.x" type="A" method="x" result="Fail"><failure><message>oops</message></failure></test><test type="A" method="y" result="Skip"/></collection></assembly></assemblies>"""


def test_xml_dialects(spark, tmp_path):
    key = ("name", "status", "message")
    assert rows(I.read_junit(spark, put(tmp_path / "j", a__xml=JUNIT)), *key) == [("pkg.T::fail", "failed", "AssertionError: 1\ntrace"), ("pkg.T::ok", "passed", ""), ("pkg.T::sk", "skipped", "later")]
    assert rows(I.read_nunit3(spark, put(tmp_path / "n", a__xml=NUNIT)), *key) == [("NS.Foo.Bar", "failed", "bad"), ("NS.Foo.Skip", "skipped", "")]
    assert rows(I.read_trx(spark, put(tmp_path / "t", a__trx=TRX)), *key) == [("NS.Calc.Add", "failed", "boom"), ("Other", "passed", "")]
    assert rows(I.read_xunit(spark, put(tmp_path / "x", a__xml=XUNIT)), *key) == [("A.x", "failed", "oops"), ("A.y", "skipped", "")]
    odd = put(tmp_path / "o", a__xml='<r><thing name="Alpha" status="FAIL"><message>m</message></thing></r>', b__xml="<r><open></r>")
    assert rows(I.read_universal_xml(spark, odd), *key) == [("Alpha", "failed", "m")]


def test_json_dialects(spark, tmp_path):
    d = put(tmp_path / "p", a__json=json.dumps({"tests": [{"nodeid": "a::b", "outcome": "FAILED", "longrepr": " x "}, {"nodeid": " "}]}), b__json=json.dumps({"report": {"tests": [{"name": "c", "status": "passed"}]}}), c__json="[1, {}]", d__json="{broken")
    assert rows(I.read_pytest_json(spark, d), "name", "status", "message") == [("a::b", "failed", "x"), ("c", "passed", "")]
    assert rows(I.read_generic_json(spark, d), "name", "status", "message") == [("", "", "")]


def test_folder_of_mixed_files(spark, tmp_path):
    d = put(tmp_path / "m", j__xml=JUNIT, n__xml=NUNIT, t__trx=TRX, p__json='[{"name": "q", "status": "ok"}]', bad__xml="<a>")
    results, rejects = I.load_results(spark, d, "p", "1")
    got = {(r["file"].split("/")[-1], r["dialect"]) for r in results.collect()}
    assert got == {("j.xml", "junit"), ("n.xml", "nunit"), ("t.trx", "trx"), ("p.json", "pytest")}
    assert [r["file"].split("/")[-1] for r in rejects.collect()] == ["bad.xml"]


def test_analysis_and_examples(spark):
    texts = [("p", "1", 'Here it is: {"analysis": [{"test_name": "t", "severity": "high"}]} done'), ("p", "2", "nothing"), ("p", "3", None)]
    got = I.read_analysis(spark.createDataFrame(texts, "project string, run_id string, text string"))
    assert rows(got, "run_id", "ord", "test_name", "severity") == [("1", 0, "t", "high")]
    ex = spark.createDataFrame([("py", 2, "a", "b"), ("py", 1, " ", "b"), ("py", 3, "c", "d"), ("cs", 1, "e", "f")], "lang string, ord long, input string, output string")
    assert rows(I.first_examples(ex), "lang", "ord") == [("cs", 1), ("py", 2)]


PY = '''import pkg.mod as m
from lib import Helper

class T:
    def test_a(self, x):
        """Doc."""
        h = Helper()
        h.run(1, 2)
        m.go()
        inner()

def inner():
    def nested():
        later()
    return nested

async def late(): ...
'''
JAVA = """package com.acme;
// class Fake { void no() {} }
public class Calc {
  private final String s = "void x() {";
  public Calc(int a) { add(a, 1); }
  @Test
  public int add(int a, int b) throws Exception { Other o = new Other(); o.call(a); return a; }
}
"""
CS = """namespace Acme { public class Box { [Fact] public async Task<int> Should_Add(int a) { return await Add(a, 2); } int Twice(int a) => a * 2; } }"""
SOURCES = "project string, file string, lang string, text string"


def test_extraction(spark):
    src = spark.createDataFrame([("p", "a.py", "python", PY), ("p", "C.java", "java", JAVA), ("p", "B.cs", "csharp", CS), ("p", "bad.py", "python", "def ("), ("p", "x.rb", "ruby", "x"), ("p", "n.py", "python", None)], SOURCES)
    f = X.extract_functions(src).cache()
    assert rows(f, "file", "key", "line") == [("B.cs", "Box::Should_Add", 1), ("B.cs", "Box::Twice", 1), ("C.java", "Calc::Calc", 5), ("C.java", "Calc::add", 7), ("a.py", "T::test_a", 5), ("a.py", "inner", 12), ("a.py", "late", 17), ("a.py", "nested", 13)]
    assert f.where("key = 'T::test_a'").first()["docstring"] == "Doc." and f.where("key = 'Calc::add'").first()["code"].endswith("return a; }")
    assert rows(X.rejects(src), "file") == [("bad.py",)]
    nodes = X.extract_nodes(f)
    assert {r["node_id"] for r in nodes.where("is_test").collect()} == {"a.py::T::test_a", "a.py::inner", "a.py::late", "a.py::inner::nested", "com.acme.C.java::Calc::add", "Acme::B.cs::Box::Should_Add"}
    calls = X.extract_calls(src)
    assert ("a.py::T::test_a", ["h", "run"], 2, "Helper") in [(r["caller"], r["chain"], r["argc"], r["hint"]) for r in calls.collect()]
    assert {tuple(r["chain"]) for r in calls.where("lang = 'java'").collect()} == {("add",), ("Other",), ("o", "call")}
    assert {tuple(r["chain"]) for r in calls.where("lang = 'csharp'").collect()} == {("Add",)}
    assert rows(X.project_languages(src.select("project", "file")), "language", "extractor") == [("python", "csharp")]


def test_python_resolution(spark):
    nodes = spark.createDataFrame([("p", "a.py::C::run", "function"), ("p", "b.py::D::run", "function"), ("p", "b.py::go", "function"), ("p", "t.py::test", "test")], "project string, node_id string, type string")
    calls = [("p", "1", "t.py::test", ["h", "run"], "C", 1), ("p", "2", "t.py::test", ["x", "go"], None, 2), ("p", "3", "t.py::test", ["len"], None, 3), ("p", "4", "t.py::test", ["other"], None, 4), ("p", "5", "b.py::go", ["go"], None, 5), ("p", "6", "b.py::go", ["run"], None, 6)]
    e, ext = C.resolve_python(spark.createDataFrame(calls, "project string, call_id string, caller string, chain array<string>, hint string, ord long"), nodes)
    assert rows(e, "src", "dst") == [("b.py::go", "a.py::C::run"), ("b.py::go", "b.py::D::run"), ("t.py::test", "a.py::C::run"), ("t.py::test", "b.py::go"), ("t.py::test", "other")]
    assert rows(ext, "node_id") == [("other",)]


def test_java_and_csharp_resolution(spark):
    nodes = spark.createDataFrame([("p", "x::A::f", "function", 1, "f", "A", "N", 1), ("p", "y::B::f", "function", 2, "f", "B", "N", 2)], "project string, node_id string, type string, node_ord long, name string, type_name string, ns string, parameters int")
    calls = spark.createDataFrame([("p", "1", "y::B::f", ["a", "f"], 1, "f", "B", "N", 2, "f1"), ("p", "2", "y::B::f", ["g"], 2, "g", None, "Json.X", 0, "f1"), ("p", "3", "q", ["f"], 3, "f", "Z", "M", 9, "f2")], "project string, call_id string, caller string, chain array<string>, ord long, name string, type_name string, ns string, argc int, file string")
    e, ext = C.resolve_java(calls, nodes)
    assert rows(e, "src", "dst") == [("q", "x::A::f"), ("y::B::f", "external::g"), ("y::B::f", "x::A::f")] and rows(ext, "node_id") == [("external::g",)]
    m = C.csharp_matches(calls, nodes)
    assert rows(m, "call_id", "node_id", "tier") == [("1", "y::B::f", 1), ("3", "x::A::f", 6), ("3", "y::B::f", 6)]
    refs = lambda *names: spark.createDataFrame([("p", n) for n in names], "project string, name string")
    kinds = calls.withColumn("kind", F.lit("call"))
    e, ext = C.resolve_csharp(kinds, nodes, refs("g"), refs("g", "Json.Net"))
    assert rows(e, "src", "dst") == [("q", "x::A::f"), ("q", "y::B::f"), ("y::B::f", "project::g")]
    assert rows(C.resolve_csharp(kinds, nodes, refs(), refs("g"))[1], "node_id") == [("nuget::g",)]
    assert rows(C.resolve_csharp(kinds, nodes)[1], "node_id") == [("external::g/0",)]
    new = kinds.where("call_id <> '2'").withColumns({"kind": F.lit("new"), "argc": F.lit(7)})
    assert rows(C.resolve_csharp(new, nodes)[0], "src", "dst") == [("q", "x::A::f"), ("q", "y::B::f"), ("y::B::f", "x::A::f")]


def test_many_projects_and_runs_in_one_read(spark, tmp_path):
    """Project and run from the folders; a later kind of file has the last word; a root's name that occurs twice, or with odd signs."""
    top = tmp_path / "c++ src" / "src"
    for project, run, name, text in (
        ("p", "r1", "b.xml", '<testsuite><testcase classname="T" name="f"><failure message="no"/></testcase></testsuite>'),
        ("p", "r1", "a.json", '[{"name": "T::f", "status": "passed", "message": ""}]'),
        ("run_project=q", "run=2024-01-01", "z.xml", '<testsuite><testcase classname="T" name="f"/></testsuite>'),
    ):
        (top / project / run).mkdir(parents=True, exist_ok=True)
        (top / project / run / name).write_text(text)
    results, rejects = I.load_results(spark, str(top))
    assert rows(results, "project", "run_id", "status") == [("p", "r1", "failed"), ("p", "r1", "passed"), ("q", "2024-01-01", "passed")] and rejects.count() == 0
    nodes = spark.createDataFrame([(p, "t.py::T::f", True, 1) for p in "pq"], "project string, node_id string, is_test boolean, node_ord long")
    assert rows(G.node_status(results, nodes, "python"), "project", "run_id", "status") == [("p", "r1", "passed"), ("q", "2024-01-01", "passed")]
    for file in ("one/src/app/src/x.py", "one/src/lib/src/x.py", "one/venv/y.py", "two/C.java", "two/obj/G.cs", "two/B.cs", "two/two.csproj"):
        (tmp_path / "c++ src" / "code" / file).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c++ src" / "code" / file).write_text('<Project><ItemGroup><PackageReference Include="Json"/><ProjectReference Include="..\\lib\\Lib.csproj"/></ItemGroup></Project>' if file.endswith("csproj") else "x")
    root = str(tmp_path / "c++ src" / "code")
    assert rows(I.read_sources(spark, root), "project", "file", "lang") == [("one", "src/app/src/x.py", "python"), ("one", "src/lib/src/x.py", "python"), ("two", "B.cs", "csharp"), ("two", "C.java", "java")]
    assert rows(I.read_sources(spark, root + "/one/", "python", "p"), "project", "file") == [("p", "src/app/src/x.py"), ("p", "src/lib/src/x.py")]
    mine, packages = I.read_csproj_refs(spark, root)
    assert rows(mine, "project", "name") == [("two", "Lib")] and rows(packages, "project", "name") == [("two", "Json")]


def test_graph_of_three_languages(spark):
    src = spark.createDataFrame([("p", "a.py", "python", PY), ("p", "lib.py", "python", "class Helper:\n    def run(self, a, b): go()\ndef go(): pass\n"), ("p", "C.java", "java", JAVA), ("q", "B.cs", "csharp", CS.replace("class Box {", "[TestFixture] class Box { int Sum(int a) { new Box(); Far(a); return Twice(a); }"))], SOURCES)
    nodes, edges, functions = C.build_graph(src)
    assert rows(edges.where("project = 'p' and origin is null"), "src", "dst") == [
        ("a.py::T::test_a", "a.py::inner"), ("a.py::T::test_a", "lib.py::Helper::run"), ("a.py::T::test_a", "lib.py::go"), ("com.acme.C.java::Calc::Calc", "com.acme.C.java::Calc::add"), ("lib.py::Helper::run", "lib.py::go"),
    ]
    assert rows(edges.where("origin is not null"), "project", "dst") == [("p", "Helper"), ("p", "external::Other"), ("p", "external::call"), ("p", "later"), ("q", "external::Add/2"), ("q", "external::Box/0"), ("q", "external::Far/1")]
    assert rows(edges.where("project = 'q' and origin is null"), "src", "dst") == [("Acme::B.cs::Box::Sum", "Acme::B.cs::Box::Twice")]
    ext = {r["node_id"]: r["origins"][0] for r in nodes.where("type = 'external'").collect()}
    assert (ext["Helper"]["package_or_module"], ext["Helper"]["symbol"], ext["Helper"]["count"]) == ("lib.Helper", "lib.Helper", 1) and ext["external::Far/1"]["namespace"] == "Acme"
    assert {r["node_id"] for r in nodes.where("project = 'q' and is_test").collect()} == {"Acme::B.cs::Box::Sum", "Acme::B.cs::Box::Should_Add", "Acme::B.cs::Box::Twice"}
    assert functions.count() == 11 and [r["edge_ord"][:5] for r in edges.where("dst = 'lib.py::go'").orderBy("src").collect()] == ["a.py:", "lib.p"]


CS_ODD = r'''namespace N {
class B {
  [Fact]
  public int f1(int a)
  {
#if NEVER
    if (a > 0) {
#else
    if (a > 1) {
#endif
      var s = $"{Far1(a, "}")} {{ }} {(a > 1 ? $"{Deep(a)}" : "{")}";
      var r = $$"""{ {{Raw(a)}} " """ + '{' + '\'';
      var v = @"c:\{"" " + $@"\{Verb(1)}" + "not closed
      int Local(int b) { return Inner(b); }
      return Local(a);
    }
    return 0;
  }
  public int P1 { get { return Prop(1); } } // void no() {
#if false
  public int gone(int a) { return 1; }
#elif true
  public int here(int a) { return 1; }
#else
  public int away(int a) {
#endif
  public int f2(int a) => f1(a);
} }
'''


def test_what_is_no_code_is_blank(spark):
    quiet = X.blank_quiet(CS_ODD, "csharp")
    assert len(quiet) == len(CS_ODD) and [i for i, c in enumerate(quiet) if c == "\n"] == [i for i, c in enumerate(CS_ODD) if c == "\n"]
    functions, calls = X.EXTRACTORS["csharp"]("x.cs", CS_ODD)
    assert [(f["key"], f["line"], f["end_line"]) for f in functions] == [("B::f1", 4, 18), ("B::here", 23, 23), ("B::f2", 27, 27)]
    assert sorted(c["chain"][-1] for c in calls) == ["Deep", "Far1", "Inner", "Local", "Raw", "Verb", "f1"]
    for broken in ('"""', '$"{', '$"{a', "/*", "'", '@"', "#if false\n{", '$$"""{{', "#else", "}"):
        assert len(X.blank_quiet(broken, "csharp")) == len(broken) and len(X.blank_quiet(broken, "java")) == len(broken)


def test_extractors_are_a_table_function_and_more_can_be_added(spark, monkeypatch):
    def ruby(file, text):
        return [dict.fromkeys((f.split()[0] for f in X.FUNCTIONS.split(", "))) | {"key": line[4:], "name": line[4:], "line": n} for n, line in enumerate(text.splitlines(), 1) if line.startswith("def ")], []

    monkeypatch.setitem(X.EXTRACTORS, "ruby", ruby)
    X.register_table_function(spark, "functions_of_any")
    src = spark.createDataFrame([("p", "a.py", "python", PY), ("p", "x.rb", "ruby", "def one\nend\ndef two\nend"), ("p", "b.cs", "csharp", CS), ("p", "bad.py", "python", "def ("), ("p", "n.py", "python", None), ("p", "q.zz", "zz", "x")], SOURCES)
    src.createOrReplaceTempView("odd_sources")
    got = spark.sql("select * from functions_of_any(table(select * from odd_sources) partition by file)")
    assert rows(got.where("lang = 'ruby'"), "file", "key", "line") == [("x.rb", "one", 1), ("x.rb", "two", 3)]
    assert rows(got, "file", "lang", "key") == rows(X.extract_functions(src), "file", "lang", "key")


def test_what_files_hold_leaves_a_task_in_small_parts():
    """A batch of many files isn't held as Python objects at once; each file comes out once, in its place."""
    import pyarrow as pa

    class Captured:
        def select(self, *names):
            return self

        def mapInArrow(self, parse, schema):
            return parse

    body = "def f(a):\n    g(a)\n" * 1000
    n, texts = 60, [None, "def ("] + [body] * 58
    batch = pa.RecordBatch.from_pydict({"project": ["p"] * n, "file": [f"{i}.py" for i in range(n)], "lang": ["python"] * n, "text": texts})
    out = list(X.parse_sources(Captured())(iter([batch])))
    assert max(sum(len(texts[int(f[:-3])] or "") for f in b.column("file").to_pylist()) for b in out) <= X._HELD and len(out) >= 58 * len(body) // X._HELD
    assert [f for b in out for f in b.column("file").to_pylist()] == [f"{i}.py" for i in range(n)]
    assert [len(x) for b in out for x in b.column("functions").to_pylist()] == [0, 0] + [1000] * 58
    assert [x for b in out for x in b.column("failed").to_pylist()] == [False, True] + [False] * 58
    assert list(X._stretches([], 5)) == [] and list(X._stretches([9, 1, 4, 1], 5)) == [(0, 1), (1, 2), (3, 1)]
