"""The data source of result files, its rejects and parts; sinks by project; manifests of the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from triage.sources import records as R
from triage.sources import results as I
from triage.streaming import status as St


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


CASES = '<testsuites><testsuite><testcase classname="T" name="a"/><testcase classname="T" name="b & c"><failure message="x"/></testcase><testcase classname="T" name="d"><failure message="y">z</failure></testcase></testsuite></testsuites>'


def names(found):
    return [r.name for r in found]


@pytest.mark.parametrize(
    ("name", "text", "good", "bad"),
    [
        ("a.xml", CASES, ["T::a", "T::d"], 1),
        ("a.xml", CASES[: CASES.index(">z<")], ["T::a"], 2),  # cut off in the middle of a record
        ("a.xml", '<s><!-- <testcase name="no"/> --><testcase name="q><failure/></testcase><testcase name="ok"><system-out><![CDATA[</testcase><testcase name="no"/>]]></system-out></testcase></s>', ["ok"], 1),
        ("a.xml", '<s><testcase name="out"><testcase name="in"/></testcase></s>', ["out", "in"], 0),
        ("a.xml", '<s xmlns="u" xmlns:x="v"><x:testcase name="n" x:other="1"><x:skipped/></x:testcase></s>', ["n"], 0),
        ("a.xml", '<test-run><test-case fullname="A.b" result="Failed"/><test-case fullname="<" result="x"/></test-run>', ["A.b"], 1),
        ("a.trx", '<r><UnitTest id="1"><TestMethod className="C" name="m"/></UnitTest><UnitTestResult testId="1" outcome="Failed"/><UnitTestResult testId="2" testName="t" outcome="&no;"/></r>', ["C.m"], 1),
        ("a.xml", "<r><open></r>", [], 1),
        ("a.xml", "", [], 1),
        ("a.xml", '<r><thing name="x" status="ok"/></r>', ["x"], 0),
        ("a.json", '[{"name": "a"}, 17, null, {"name": "b", "message": {"x": 1}}]', ["a", "b"], 2),
        ("a.json", '{"tests": [{"nodeid": "a"}, {"nodeid": "b" "x": 1}, {"nodeid": "c"}', ["a", "c"], 1),
        ("a.json", "{broken", [], 1),
        ("a.json", "3", [], 1),
    ],
)
def test_a_broken_record_costs_itself_alone(name, text, good, bad):
    found, rejects = R.file_records(name, text.encode())
    assert names(found) == good and len(rejects) == bad


def test_encodings_are_kept():
    text = '<?xml version="1.0" encoding="{}"?><s><testcase name="Prüfung ß"/></s>'
    for encoding in ("utf-8", "iso-8859-1", "utf-16"):
        assert names(R.file_records("a.xml", text.format(encoding).encode(encoding))[0]) == ["Prüfung ß"]


def test_every_file_is_opened_once_and_large_ones_are_read_in_parts(spark, tmp_path):
    case = lambda k: f'<testcase classname="T" name="n{k}"><failure message="m{k}">{"text " * (k % 7)}</failure></testcase>' if k % 11 else '<testcase name="a & b"/>'
    big = "<testsuite>\n" + "\n".join(map(case, range(600))) + "\n</testsuite>"
    top = put(tmp_path / "in" / "p" / "r", big__xml=big, small__json='[{"name": "x", "status": "passed"}]', one__xml=CASES, note__txt="no", _hidden__xml=CASES)
    whole = I.result_rows(spark, str(tmp_path / "in"))
    parts = I.result_rows(spark, str(tmp_path / "in"), splitBytes=1000, packBytes=100)
    assert parts.rdd.getNumPartitions() > 30 and whole.rdd.getNumPartitions() == 1
    key = ["file", "dialect", "ord", "name", "status", "message", "reason"]
    rows = lambda df: sorted((tuple(str(r[c]) for c in key) for r in df.collect()))
    assert rows(whole) == rows(parts)
    assert whole.where("reason is not null and file like '%big.xml'").count() == 55 and whole.where("reason is null and file like '%big.xml'").count() == 545
    results, rejects = I.load_results(spark, str(tmp_path / "in"))
    assert {(r["project"], r["run_id"]) for r in results.collect()} == {("p", "r")} and rejects.where("ord is not null").count() == 56
    by_spark = I.parsed_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,json}").load(top))
    assert sorted(r["name"] for r in by_spark.where("reason is null and file not like '%hidden%'").collect()) == sorted(r["name"] for r in results.collect())


def test_no_files_and_a_missing_folder(spark, tmp_path):
    assert I.load_results(spark, put(tmp_path / "none"))[0].count() == 0
    with pytest.raises(Exception, match="nowhere"):
        I.load_results(spark, str(tmp_path / "nowhere"))


def test_a_projects_report_replaces_its_own_alone(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "project string, n int")
    for write, read in ((I.write_json, lambda p: {(r["project"], json.loads(r["value"])["n"]) for r in spark.read.text(p).collect()}), (I.write_tables, lambda p: {(r["project"], r["n"]) for r in spark.read.parquet(p).collect()})):
        to = str(tmp_path / write.__name__)
        write(frame(("p", 1), ("p", 2), ("q", 3)), to)
        write(frame(("q", 4)), to)
        assert read(to) == {("p", 1), ("p", 2), ("q", 4)}
        fails = frame(*[("p", k) for k in range(20)]).repartition(4).withColumn("n", F.when(F.col("n") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
        with pytest.raises(Exception, match="lost"):
            write(fails, to)
        assert read(to) == {("p", 1), ("p", 2), ("q", 4)}
        write(frame(), to)
        assert read(to) == {("p", 1), ("p", 2), ("q", 4)}


def test_the_stored_state_doesnt_grow_with_the_batches(spark, tmp_path):
    nodes = spark.createDataFrame([("p", f"a.py::f{i}", True, i) for i in range(3)], "project string, node_id string, is_test boolean, node_ord long")
    batch = lambda n: spark.createDataFrame([("p", "1", f"a.py::f{n % 3}", "passed" if n % 2 else "failed", f"m{n}", n)], "project string, run_id string, name string, status string, message string, ord long").withColumn("modified", F.timestamp_seconds(F.lit(1_700_000_000 + n)))
    target = str(tmp_path / "state")
    for n in range(9):
        St.apply_batch(batch(n), n, nodes, "python", target)
    St.apply_batch(batch(5), 5, nodes, "python", target)  # run again
    assert {r["node_id"]: (r["status"], r["error_message"]) for r in St.current(spark, target).collect()} == {"a.py::f0": ("failed", "m6"), "a.py::f1": ("passed", "m7"), "a.py::f2": ("failed", "m8")}
    assert len([f for f in os.listdir(f"{target}/manifests") if f.startswith("version=")]) == St.KEEP
    parts = [d for d, _, files in os.walk(f"{target}/state") if any(f.endswith(".parquet") for f in files)]
    assert len(parts) <= St.KEEP + 3
