"""Test-result files as one table: project, run_id, file, dialect, ord, name, status, message.

A file is opened once, by the data source ``test_results`` of ``result_source`` or, in stores that only Spark reaches, by Spark as bytes; its
dialect is the one that finds most named records in it, told while it is read. Records and files that can't be read are rows of ``rejects``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.functions import text as T
from triage.sources import result_source
from triage.sources.records import PRIORITY, file_records
from triage.sources.shared import written

# The order in which files of a folder are taken.
EXT_RANK = {".xml": 1, ".trx": 2, ".json": 3}


def ext_rank(file: Column) -> Column:
    return F.when(file.endswith(".xml"), 1).when(file.endswith(".trx"), 2).when(file.endswith(".json"), 3)


def relative(file: Column, path: str) -> Column:
    """A file's path below ``path``, the folder that was read (or the file's own name): what follows the folder as it stands in the file's URI, first time; decoded."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    spelt = dict.fromkeys((quote(root, safe="/+!$&'()*,;=:@~"), quote(root), root))
    below = [F.when(F.locate(f"{r}/", file) > 0, F.substring(file, F.locate(f"{r}/", file) + F.lit(len(r) + 1), F.length(file))) for r in spelt]
    rel = F.coalesce(*below, F.substring_index(file, "/", -1))
    return F.coalesce(F.try_url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))), rel)


def folder(rel: Column, n: int) -> Column:
    """The n-th folder of a relative path; of a folder written as ``name=value`` the value. Null if there are fewer."""
    parts = F.split(rel, "/")
    return F.when(F.size(parts) > n, F.regexp_replace(F.try_element_at(parts, F.lit(n)), "^[^=]*=", ""))


def list_result_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, ext_rank, modified`` of every result file under ``path`` (or of the file itself)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,trx,json}").load(path)
    file = F.col("_metadata.file_path")  # as the other readers spell it
    return files.select(file.alias("file"), ext_rank(file).alias("ext_rank"), F.col("modificationTime").alias("modified"))


def _parsed(batches: Iterator[pa.RecordBatch], only: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the data source from whole files (``path, modificationTime, content``)."""
    for batch in batches:
        for path, modified, content in zip(*(batch.column(c) for c in ("path", "modificationTime", "content"))):
            uri = path.as_py()
            yield from result_source.batches(result_source.as_rows(uri, modified.cast(pa.timestamp("us", "UTC")).value, *file_records(uri, content.as_py(), only)))


def parsed_files(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """Rows as of the data source from the bytes of files, read by Spark as ``binaryFile``, in a batch or a stream."""
    return files.select("path", "modificationTime", "content").mapInArrow(lambda batches: _parsed(batches, dialect), result_source.SCHEMA)


def result_rows(spark: SparkSession, path: str | list[str], dialect: str | None = None, **options: object) -> DataFrame:
    """``file, modified, dialect, ord, name, status, message, reason`` of all result files under the paths, each opened once; ``dialect``: in this one, whatever else a file holds."""
    paths = [path] if isinstance(path, str) else list(path)
    if not all(result_source.reachable(p) for p in paths):
        return parsed_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,trx,json}").load(paths), dialect)
    spark.dataSource.register(result_source.ResultFiles)
    reader = spark.read.format("test_results").option("files", json.dumps(paths))
    for k, v in (options | ({"dialect": dialect} if dialect else {})).items():
        reader = reader.option(k, v)
    return reader.load()


def _of(spark: SparkSession, path: str | list[str], dialect: str) -> DataFrame:
    rows = result_rows(spark, path, dialect).where("reason is null")
    return rows.select("file", "dialect", "ord", *T.normalize_record(F.col("name"), F.col("status"), F.col("message")))


_BODY = "struct<_message:string,_VALUE:string,message:array<string>>"


JUNIT = f"_classname string, _name string, failure array<{_BODY}>, error array<{_BODY}>, skipped array<{_BODY}>"


def junit_fields() -> list[Column]:
    """name, status, message of a ``testcase`` with the columns of ``JUNIT``."""
    said = F.coalesce(F.try_element_at("failure", F.lit(1)), F.try_element_at("error", F.lit(1)), F.try_element_at("skipped", F.lit(1)))
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    parts = F.filter(F.concat(F.array(said["_message"], said["_VALUE"]), F.coalesce(said["message"], F.array().cast("array<string>"))), lambda x: F.coalesce(T.strip(x), F.lit("")) != "")
    name = F.when(F.coalesce("_classname", F.lit("")) != "", F.concat("_classname", F.lit("::"), F.coalesce("_name", F.lit("")))).otherwise(F.coalesce("_name", F.lit("")))
    return T.normalize_record(name, status, F.array_join(F.transform(parts, T.strip), "\n"))


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """``testcase`` at any depth. A failure or error decides before a skip; empty names stay."""
    return _of(spark, path, "junit")


def read_nunit3(spark: SparkSession, path: str) -> DataFrame:
    return _of(spark, path, "nunit")


def read_xunit(spark: SparkSession, path: str) -> DataFrame:
    return _of(spark, path, "xunit")


def read_trx(spark: SparkSession, path: str) -> DataFrame:
    """Results named by their definitions; the last definition of an id counts. Any outcome but a failure or a skip is a pass."""
    return _of(spark, path, "trx")


def read_pytest_json(spark: SparkSession, path: str) -> DataFrame:
    return _of(spark, path, "pytest")


def read_generic_json(spark: SparkSession, path: str) -> DataFrame:
    return _of(spark, path, "json")


def read_universal_xml(spark: SparkSession, path: str) -> DataFrame:
    """Elements that look like tests in files of no known kind, in document order."""
    return _of(spark, path, "universal")


def json_records(df: DataFrame, dialect: str) -> DataFrame:
    """Records of variants ``v`` by file: ``pytest`` takes tests, report.tests or the list itself and drops blank names; ``json`` takes the list alone and keeps them."""
    get = lambda v, p: F.try_variant_get(v, p, "array<variant>")
    items = F.coalesce(get("v", "$.tests"), get("v", "$.report.tests"), get("v", "$")) if dialect == "pytest" else get("v", "$")
    each = df.select("file", F.posexplode(items).alias("ord", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    f = lambda p: F.try_variant_get("r", f"$.{p}", "string")
    a = (("nodeid", "name"), ("outcome", "status"), ("longrepr", "message")) if dialect == "pytest" else (("name",), ("status",), ("message",))
    name, status, message = (F.coalesce(*[T.blank_to_null(f(x)) for x in xs], F.lit("")) for xs in a)
    out = each.select("file", F.lit(dialect).alias("dialect"), F.col("ord").cast("long").alias("ord"), *T.normalize_record(name, status, message))
    return out.where("name <> ''") if dialect == "pytest" else out


def choose_dialect(records: DataFrame) -> DataFrame:
    """``file, dialect``: the one with most named records; ties go to the lower priority. A file in which none has a name goes to universal, or pytest if it is JSON."""
    named = F.count_if(F.col("name") != "")
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("dialect")), F.lit(100))
    counts = records.groupBy("file", "dialect").agg(named.alias("n")).withColumn("p", priority)
    best = counts.groupBy("file").agg(F.min_by("dialect", F.struct(-F.col("n"), "p", "dialect")).alias("best"), F.max("n").alias("n"))
    return best.select("file", F.when(F.col("n") > 0, F.col("best")).when(F.col("file").endswith(".json"), "pytest").otherwise("universal").alias("dialect"))


def load_results(spark: SparkSession, path: str, project: str | None = None, run_id: str | None = None, dialects: tuple[str, ...] | None = None, files: list[str] | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """(results, rejects): the records of every file in its dialect; ``file, ord, reason`` of records and (``ord`` null) files that can't be read.

    Many projects and runs are one read: without ``project`` the first folder below ``path`` names it, and
    without ``run_id`` the next one. ``place`` orders a run's records: by kind of file, path, place in it;
    ``modified`` is the time of the file. ``files``: of the files under ``path`` these alone. ``dialects``: files of these alone. ``options``: of the data source.
    """
    rows = written(result_rows(spark, path if files is None else files, **options), "records")  # each file is read once, whatever is asked of its records
    return located_records(rows, path, project, run_id, dialects), rows.where("reason is not null").select("file", "ord", "reason")


def located_records(rows: DataFrame, path: str, project: str | None = None, run_id: str | None = None, dialects: tuple[str, ...] | None = None) -> DataFrame:
    """The records among the data source's rows, with their project, run and place; in a batch or a stream."""
    own = rows.where("reason is null")
    if dialects is not None:
        own = own.where(F.col("dialect").isin(*dialects))
    rel = relative(F.col("file"), path)
    of_project = folder(rel, 1) if project is None else F.lit(project)
    of_run = folder(rel, 2 if project is None else 1) if run_id is None else F.lit(run_id)
    place = F.struct(ext_rank(F.col("file")).alias("kind"), F.col("file"), F.col("ord"))
    return own.select(of_project.alias("project"), of_run.alias("run_id"), "file", "dialect", "ord", place.alias("place"), *T.normalize_record(F.col("name"), F.col("status"), F.col("message")), "modified")


def first_json_block(content: str | None) -> str | None:
    """The text if it is JSON, else its first balanced ``{...}`` if that is; None if there is none. Braces within strings count.

    Depths are a running sum over the bytes, so a text of any length takes as many steps as it has braces.
    """
    if not content:
        return None
    try:
        json.loads(content)
        return content
    except ValueError:
        pass
    raw = np.frombuffer(content.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    braces = np.flatnonzero((raw == 0x7B) | (raw == 0x7D))
    first = np.flatnonzero(raw[braces] == 0x7B)
    if not len(first):
        return None
    braces = braces[first[0] :]  # closing ones before any opening one don't count
    depth = np.cumsum(np.where(raw[braces] == 0x7B, 1, -1))
    closed = np.flatnonzero(depth == 0)
    if not len(closed):
        return None
    block = raw[braces[0] : braces[closed[0]] + 1].tobytes().decode("utf-8", "surrogatepass")
    try:
        json.loads(block)
        return block
    except ValueError:
        return None


_ANALYSIS = "struct<test_name:string,error:string,call_path:array<string>,locus:struct<files:array<string>,functions:array<string>,suspects:array<string>>,failure_type:string,root_cause:string,severity:string,suggested_fixes:array<string>,rationale:array<string>,insight_bullets:array<string>,heuristic_locations:array<string>>"


#: Bytes of answers that leave a task as one batch, or one answer.
_ANSWERS = 4 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``project, run_id, text`` with the JSON of each text in its place; one text at a time is a Python object."""
    for batch in batches:
        text, begin, size, found = batch.column("text"), 0, 0, []
        for i in range(len(text)):
            found.append(first_json_block(text[i].as_py()))
            size += len(found[-1] or "")
            if size >= _ANSWERS or i + 1 == len(text):
                part = batch.slice(begin, len(found))
                yield pa.RecordBatch.from_arrays([part.column("project"), part.column("run_id"), pa.array(found, pa.string())], names=["project", "run_id", "text"])
                begin, size, found = i + 1, 0, []


def read_analysis(texts: DataFrame) -> DataFrame:
    """Items of model answers: ``project, run_id, text`` -> one row an item, with ``ord``. A text without JSON gives none."""
    own = texts.select("project", "run_id", F.col("text").cast("string").alias("text"))
    items = F.from_json("text", f"analysis array<{_ANALYSIS}>")["analysis"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)  # every column may be null
    found = own.mapInArrow(_blocks, kinds).select("project", "run_id", F.posexplode(items).alias("ord", "item"))
    return found.select("project", "run_id", F.col("ord").cast("long").alias("ord"), "item.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``lang, ord, input, output`` of files ``<lang>.json``, each a list of objects; other values and broken files give none. A ``reasoning`` key of an output is called ``rationale``."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    lang = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    items = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    each = raw.select(lang.alias("lang"), F.posexplode(items).alias("ord", "r"))
    text = lambda k: F.try_variant_get("r", f"$.{k}", "string")
    return each.select("lang", F.col("ord").cast("long").alias("ord"), text("input").alias("input"), T.rationale(text("output")).alias("output"))


def first_examples(examples: DataFrame, per_lang: int = 1) -> DataFrame:
    """The first valid examples (``lang, ord, input, output``) of each language; a rank that Spark cuts before the shuffle."""
    valid = examples.where("trim(coalesce(input, '')) <> '' and trim(coalesce(output, '')) <> ''")
    return valid.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("ord"))).where(F.col("n") <= per_lang).drop("n")


# Folders that hold no sources of one's own, in lower case, and endings of generated files, by language.
EXCLUDED_FOLDERS = {
    "python": (".venv", "venv", "env", "site-packages", "__pycache__", ".tox", ".pytest_cache", "build", "dist"),
    "java": ("target", "build", "out", "bin", ".gradle", ".idea", ".mvn", ".git", ".github", "generated", "generated-sources", "generated-test-sources"),
    "csharp": ("bin", "obj", ".vs", ".git", ".github", ".idea", ".vscode", "packages", ".nuget", "testresults", "coverage", ".sonarqube", ".azure-pipelines", ".artifacts", "out", "build", "target", "generated"),
}
EXCLUDED_ENDINGS = {"python": (), "java": (".generated.java",), "csharp": (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", "assemblyinfo.cs")}


def read_sources(spark: SparkSession, path: str, lang: str | None = None, project: str | None = None) -> DataFrame:
    """``project, file, lang, text`` of a language's files under ``path``, of all languages without ``lang``; folder names compare without case.

    Without ``project`` the first folder below ``path`` names it, so that many projects are one read.
    """
    langs = list(EXCLUDED_FOLDERS) if lang is None else [lang]
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(T.EXTENSIONS[x] for x in langs) + "}").text(path)
    rel = relative(F.col("_metadata.file_path"), path)
    out = raw.select(rel.alias("_rel"), F.col("value").alias("text"))
    file = F.col("_rel") if project is not None else F.when(F.contains("_rel", F.lit("/")), F.regexp_replace("_rel", "^[^/]*/", "")).otherwise(F.col("_rel"))
    out = out.select((folder(F.col("_rel"), 1) if project is None else F.lit(project)).alias("project"), file.alias("file"), T.language_of(F.col("_rel")).alias("lang"), "text")
    parts, bad = F.transform(F.split("file", "/"), F.lower), F.lit(False)
    for x in langs:
        own = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED_FOLDERS[x])))
        for e in EXCLUDED_ENDINGS[x]:
            own = own | F.lower("file").endswith(e)
        bad = bad | ((F.col("lang") == x) & own)
    return out.where(~bad)


def read_csproj_refs(spark: SparkSession, path: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``project, name`` of referenced projects, the same of packages), distinct. Without ``project``: as in ``read_sources``."""

    def read(tag: str) -> DataFrame:
        found = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csproj").schema("_Include string").load(path).where("_Include is not null")
        return found.select((folder(relative(F.col("_metadata.file_path"), path), 1) if project is None else F.lit(project)).alias("project"), "_Include")

    stem = F.regexp_replace(F.regexp_replace(F.replace("_Include", F.lit("\\"), F.lit("/")), "^.*/", ""), r"\.[^.]*$", "")
    return read("ProjectReference").select("project", stem.alias("name")).distinct(), read("PackageReference").select("project", F.col("_Include").alias("name")).distinct()


def _projects(df: DataFrame):
    """A writer that replaces the projects of ``df`` and leaves the others: files are staged, and move when the whole job has succeeded."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, a folder for each project; the folders of projects without a row stay as they are."""
    _projects(df.select("project", F.to_json(F.struct("*")).alias("value"))).text(path)


def write_tables(df: DataFrame, path: str) -> None:
    """Parquet, a folder for each project; the folders of projects without a row stay as they are."""
    _projects(df).parquet(path)
