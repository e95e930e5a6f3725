"""Declarations, code and call sites from source files: small per-file parsers behind one ``mapInArrow``.

``sources``: project, file, lang, text. ``parse_sources`` reads each file once; functions, calls and rejects come
from its table. Python files are parsed by ``ast``. Java and C# files go through one
scanner that blanks what is no code (comments, strings of every kind but for the holes of interpolated ones, preprocessor lines and
the branches they rule out), then finds types, signatures and their balancing braces. Local functions and lambdas belong to the method
around them, accessors of properties to none. A file that can't be parsed gives no
rows of its own and one of ``rejects``; it stops nothing.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

FUNCTIONS = "key string, name string, node_id string, owner string, ns string, depth int, line int, end_line int, docstring string, code string, parameters int, annotations array<string>, type_annotations array<string>, is_parametrized boolean, is_async boolean, return_type string"
CALLS = "ns string, caller string, caller_type string, chain array<string>, argc int, hint string, kind string, line int, module string"


# --- Python -----------------------------------------------------------------------------------------


def _chain(node: ast.AST) -> list[str]:
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return [*_chain(node.value), node.attr]
    return _chain(node.func) if isinstance(node, ast.Call) else []


def _python(file: str, text: str) -> tuple[list[dict], list[dict]]:
    tree, lines = ast.parse(text), text.splitlines()
    imports: dict[str, list[str]] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports |= {a.asname or a.name.split(".")[-1]: a.name.split(".") for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            imports |= {a.asname or a.name: [*n.module.split("."), a.name] for a in n.names}
    functions, calls = [], []

    def qualified(chain: list[str]) -> list[str]:
        return [*imports.get(chain[0], chain[:1]), *chain[1:]] if chain else chain

    def body_of(node: ast.AST, types: dict[str, str], out: list) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and (made := qualified(_chain(child.value.func))):
                types |= {t.id: made[-1] for t in child.targets if isinstance(t, ast.Name)}
            if isinstance(child, ast.Call) and (chain := _chain(child.func)):
                out.append((child, chain))
            body_of(child, types, out)

    def visit(node: ast.AST, owner: str | None, stack: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, child.name, stack)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                path = [*stack, child.name]
                node_id = "::".join([file, *([owner] if owner else []), *path])
                decorators = [_chain(d) for d in child.decorator_list]
                functions.append({
                    "key": "::".join([*([owner] if owner else []), child.name]), "name": child.name, "node_id": node_id, "owner": owner, "ns": None, "depth": len(stack) + bool(owner), "line": child.lineno, "end_line": child.end_lineno,
                    "docstring": ast.get_docstring(child) or "", "code": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "parameters": len(child.args.args) + len(child.args.posonlyargs) + len(child.args.kwonlyargs),
                    "annotations": [".".join(d) for d in decorators], "type_annotations": [], "is_parametrized": any(d[-1:] == ["parametrize"] for d in decorators), "is_async": isinstance(child, ast.AsyncFunctionDef), "return_type": ast.unparse(child.returns) if child.returns else None,
                })
                types: dict[str, str] = {}
                sites: list = []
                body_of(child, types, sites)
                for call, chain in sites:
                    calls.append({"ns": None, "caller": node_id, "caller_type": owner, "module": ".".join(imports[chain[0]]) if chain[0] in imports else None, "chain": qualified(chain), "argc": len(call.args) + len(call.keywords), "hint": types.get(chain[0]) if len(chain) > 1 else None, "kind": "call", "line": call.lineno})
                visit(child, owner, path)
            else:
                visit(child, owner, stack)

    visit(tree, None, [])
    return functions, calls


# --- Java and C# ------------------------------------------------------------------------------------

#: What ends a stretch of code, by language: comments, the openings of strings and characters, preprocessor lines (``#``); braces count within holes.
_OPENERS = {
    "java": re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>"""(?:\\.|(?!""").)*(?:"""|\Z))|(?P<plain>"(?:\\.|[^"\\\n])*"?)|(?P<char>\'(?:\\.|[^\'\\\n])*\'?)', re.S),
    "csharp": re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<directive>(?m:^)[ \t]*\#[ \t]*(?P<word>\w*)(?P<rest>[^\n]*))|(?P<string>(?P<signs>[$@]*)(?P<quotes>"{3,}|"))|(?P<char>\'(?:\\.|[^\'\\\n])+\')|(?P<brace>[{}])', re.S),
}
_BRANCH = re.compile(r"^[ \t]*#[ \t]*(if|elif|else|endif)\b([^\n]*)", re.M)
_TYPE = re.compile(r"(?P<marks>(?:(?:\[[^\]\n]*\]|@\w[\w.]*(?:\([^)]*\))?)\s*)*)(?:\b(?:public|private|protected|internal|static|final|abstract|sealed|partial)\s+)*\b(?:class|struct|record|interface|enum)\s+(?P<name>\w+)[^;{(]*(?:\([^)]*\))?[^;{]*\{")
_NAMESPACE = re.compile(r"\b(?:namespace|package)\s+([\w.]+)")
_SIGNATURE = re.compile(r"(?P<marks>(?:(?:\[[^\]\n]*\]|@\w[\w.]*(?:\([^)]*\))?)\s*)*)(?P<head>(?:\b(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|default|extern|partial|native|unsafe|readonly)\s+)*)(?P<type>\w[\w.]*(?:<[^;{}()]*>)?(?:\[\])*\??\s+)?(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^(){};]*)\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{;]+|:\s*(?:base|this)\s*\([^)]*\)\s*)?(?P<body>\{|=>|;)")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?<![\w.])(?P<chain>[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*(?:<[\w\s,.]*>)?\s*\(")
_MADE = re.compile(r"(\w+)\s*=\s*new\s+([\w.]+)")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "new", "using", "lock", "foreach", "synchronized", "throw", "else", "do", "try", "sizeof", "typeof", "nameof", "super", "this", "base", "await", "yield", "case", "when", "fixed", "assert", "instanceof", "default"}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _ruled_out(text: str, begin: int) -> int:
    """Where the branch that begins at ``begin`` ends: at the next directive of its own ``#if``."""
    depth = 0
    for m in _BRANCH.finditer(text, begin):
        if m[1] == "if":
            depth += 1
        elif depth == 0:
            return m.start()
        elif m[1] == "endif":
            depth -= 1
    return len(text)


def _string_end(text: str, at: int, dollars: int, verbatim: bool, quotes: int) -> tuple[int, bool]:
    """(where a C# string that goes on at ``at`` stops, whether that is a hole): the place after its last quote, or after the braces that open a hole."""
    while at < len(text):
        c = text[at]
        if c == '"':
            run = len(re.compile('"+').match(text, at)[0])
            if quotes >= 3:
                if run >= quotes:
                    return at + run, False
                at += run
            elif verbatim and run >= 2:
                at += 2
            else:
                return at + 1, False
        elif c == "\\" and not verbatim and quotes < 3:
            at += 2
        elif c == "\n" and not verbatim and quotes < 3:
            return at, False  # never closed
        elif c == "{" and dollars:
            run = len(re.compile("{+").match(text, at)[0])
            if quotes >= 3:
                if run >= dollars:
                    return at + run, True
                at += run
            elif run % 2:
                return at + run, True
            else:
                at += run
        else:
            at += 1
    return len(text), False


def blank_quiet(text: str, lang: str = "csharp") -> str:
    """What is no code as blanks, every position kept. Strings within the holes of strings nest as deep as they do.

    Of the branches of ``#if`` the first counts whose condition isn't ``false``.
    """
    out: list[str] = []
    at, opener = 0, _OPENERS[lang]
    holes: list[list] = []  # strings that a hole was opened in: their kind, and how many braces are open in the hole
    branches: list[bool] = []  # whether one branch of each open #if was taken
    while at < len(text):
        m = opener.search(text, at)
        if m is None:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("word", "rest", "signs", "quotes") else "directive" if m["directive"] is not None else "string"
        if kind == "brace":
            out.append(m[0])
            if holes:
                holes[-1][1] += 1 if m[0] == "{" else -1
                if holes[-1][1] < 0:  # back in the string; a raw one may need more braces
                    (dollars, verbatim, quotes), _ = holes.pop()
                    out[-1] = " "
                    at = _go_on(text, at, (dollars, verbatim, quotes), holes, out)
        elif kind == "directive":
            out.append(_blank(m[0]))
            word = m["word"]
            if word == "if":
                branches.append(m["rest"].split("//")[0].strip() not in ("false", "0"))
            elif word == "endif" and branches:
                branches.pop()
            elif word in ("elif", "else") and branches and not branches[-1]:
                branches[-1] = word == "else" or m["rest"].split("//")[0].strip() not in ("false", "0")
                if branches[-1]:
                    continue
            if (word == "if" and not branches[-1]) or (word in ("elif", "else") and branches):
                stop = _ruled_out(text, at)
                out.append(_blank(text[at:stop]))
                at = stop
        elif kind == "string":
            out.append(_blank(m[0]))
            at = _go_on(text, at, (m["signs"].count("$"), "@" in m["signs"], len(m["quotes"])), holes, out)
        else:
            out.append(_blank(m[0]))
    return "".join(out)


def _go_on(text: str, at: int, spec: tuple[int, bool, int], holes: list[list], out: list[str]) -> int:
    """Blanks a C# string from ``at`` on to its end or its next hole; returns where that is."""
    stop, hole = _string_end(text, at, *spec)
    out.append(_blank(text[at:stop]))
    if hole:
        holes.append([spec, 0])
    return stop


def block_end(text: str, begin: int) -> int:
    """The place after the brace that balances the first one from ``begin`` on; the end of the text if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", text[begin:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return begin + m.end()
    return len(text)


def _count(args: str) -> int:
    depth, n = 0, 1 if args.strip() else 0
    for c in args:
        depth += (c in "<([") - (c in ">)]")
        n += c == "," and not depth
    return n


def _call_args(text: str, begin: int) -> int:
    depth = 0
    for i in range(begin, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return _count(text[begin + 1 : i])
    return 0


def marks_of(text: str) -> list[str]:
    """Names of annotations and attributes."""
    return [x.strip().lstrip("@") for x in re.findall(r"@\w[\w.]*|(?<=[\[,])\s*\w[\w.]*", text)]


def _braced(lang: str) -> Callable[[str, str], tuple[list[dict], list[dict]]]:
    def scan(file: str, text: str) -> tuple[list[dict], list[dict]]:
        quiet = blank_quiet(text, lang)
        ns = (m := _NAMESPACE.search(quiet)) and m[1]
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_right(breaks, at - 1) + 1
        types = [(m.start("name"), block_end(quiet, m.end() - 1), m["name"], marks_of(m["marks"])) for m in _TYPE.finditer(quiet)]
        begins = [t[0] for t in types]
        functions, calls, inside = [], [], 0
        for m in _SIGNATURE.finditer(quiet):
            at, name = m.start("name"), m["name"]
            # the innermost type: the last that begins before and ends behind
            owner, type_marks = next(((t, marks) for _, e, t, marks in reversed(types[: bisect_right(begins, at - 1)]) if at < e), (None, []))
            made = name == owner
            if owner is None or name in _WORDS or at < inside or (not made and not m["type"]) or (m["type"] or "").strip() in _WORDS:
                continue
            end = block_end(quiet, m.start("body")) if m["body"] == "{" else quiet.find(";", m.start("body")) + 1 or len(text)
            inside = end if m["body"] != ";" else inside
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            node_id = "::".join([*([ns or "<global>"] if lang == "csharp" else []), *([f"{ns}.{file}" if ns and lang == "java" else file]), owner, name])
            functions.append({
                "key": f"{owner}::{name}", "name": name, "node_id": node_id, "owner": owner, "ns": ns, "depth": 1, "line": line(at), "end_line": line(end), "docstring": "", "code": text[begin:end].rstrip(),
                "parameters": _count(m["args"]), "annotations": marks_of(m["marks"]), "type_annotations": type_marks, "is_parametrized": False, "is_async": "async" in m["head"].split(), "return_type": (m["type"] or "").strip() or None,
            })
            body = quiet[m.start("body") : end]
            hints = {v: t.split(".")[-1] for v, t in _MADE.findall(body)}
            # functions declared in the body are no calls; what they call is the method's
            declared = {x.start("name") for x in _SIGNATURE.finditer(body) if x["type"] and x["body"] != ";" and x["type"].strip() not in _WORDS}
            for c in _CALL.finditer(body):
                if c.start("chain") in declared:
                    continue
                chain = [x.strip() for x in c["chain"].split(".")]
                if chain[-1] not in _WORDS:
                    place = m.start("body") + c.start()
                    calls.append({"ns": ns, "caller": node_id, "caller_type": owner, "chain": chain, "argc": _call_args(quiet, m.start("body") + c.end() - 1), "hint": hints.get(chain[0]) if len(chain) > 1 else None, "kind": "new" if c["new"] else "call", "line": line(place), "module": None})
        return functions, calls

    return scan


#: Parsers by language; callers may add theirs: (file, text) -> (functions, calls).
EXTRACTORS: dict[str, Callable[[str, str], tuple[list[dict], list[dict]]]] = {"python": _python, "java": _braced("java"), "csharp": _braced("csharp")}


_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _struct(schema: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _KINDS[t]) for n, t in (f.split() for f in schema.split(", "))]))


#: Bytes of source text whose functions and calls a task holds at once, which are some fifty times that as Python objects.
_HELD = 256 << 10


def _stretches(lengths: list[int], held: int) -> Iterator[tuple[int, int]]:
    """(first, number) of files in a row, of more than ``held`` bytes only if one file alone has more."""
    first = total = 0
    for i, n in enumerate(lengths):
        if i > first and total + n > held:
            yield first, i - first
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths) - first


def parse_sources(sources: DataFrame) -> DataFrame:
    """``project, file, lang, functions array<struct>, calls array<struct>, failed``: every file once. Unknown languages give nothing.

    What was found leaves the task every ``_HELD`` bytes of text, however many files a batch has.
    """
    known = dict(EXTRACTORS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, n in _stretches([x or 0 for x in pc.binary_length(whole.column("text")).to_pylist()], _HELD):
                batch = whole.slice(first, n)
                functions, calls, failed = [], [], []
                for file, lang, text in zip(*(batch.column(c).to_pylist() for c in ("file", "lang", "text"))):
                    try:
                        found, bad = (known[lang](file, text or "") if lang in known else ([], [])), False
                    except (SyntaxError, ValueError, RecursionError):
                        found, bad = ([], []), True
                    functions.append(found[0])
                    calls.append(found[1])
                    failed.append(bad)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("project", "file", "lang")), pa.array(functions, _struct(FUNCTIONS)), pa.array(calls, _struct(CALLS)), pa.array(failed, pa.bool_())],
                    names=["project", "file", "lang", "functions", "calls", "failed"],
                )

    typed = lambda schema: "array<struct<" + ", ".join(":".join(f.split()) for f in schema.split(", ")) + ">>"
    return sources.select("project", "file", "lang", "text").mapInArrow(parse, f"project string, file string, lang string, functions {typed(FUNCTIONS)}, calls {typed(CALLS)}, failed boolean")


def register_table_function(spark: SparkSession, name: str = "functions_of") -> None:
    """Makes the extractors that are known now a table function of SQL: ``SELECT * FROM functions_of(TABLE(sources) PARTITION BY file)``.

    The table has ``file, lang, text`` and any other columns; a row of ``FUNCTIONS`` comes out for each function, with ``file`` and ``lang``. Files that can't be parsed give none.
    """
    known, names = dict(EXTRACTORS), [f.split()[0] for f in FUNCTIONS.split(", ")]

    class Functions:
        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                found, _ = known[row["lang"]](row["file"], row["text"] or "") if row["lang"] in known else ([], [])
            except (SyntaxError, ValueError, RecursionError):
                found = []
            for f in found:
                yield (row["file"], row["lang"], *[f[n] for n in names])

    spark.udtf.register(name, udtf(Functions, returnType=f"file string, lang string, {FUNCTIONS}"))


def _parsed(sources: DataFrame) -> DataFrame:
    return sources if "functions" in sources.columns else parse_sources(sources)


def extract_functions(sources: DataFrame) -> DataFrame:
    """``project, file, lang`` and ``FUNCTIONS``; of sources or of their parsed table."""
    return _parsed(sources).select("project", "file", "lang", F.explode("functions").alias("f")).select("project", "file", "lang", "f.*")


def extract_calls(sources: DataFrame) -> DataFrame:
    """``project, file, lang``, ``CALLS``, ``call_id``, ``name`` (the last of the chain), ``type_name`` (the caller's type) and ``ord``, which orders all calls of a project by file and line."""
    each = _parsed(sources).select("project", "file", "lang", F.posexplode("calls").alias("pos", "c")).select("project", "file", "lang", "pos", "c.*")
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return each.withColumns({
        "call_id": F.concat("file", F.lit("#"), F.col("pos").cast("string")),
        "name": F.try_element_at("chain", F.lit(-1)),
        "type_name": F.col("caller_type"),
        "ord": F.concat("file", F.lit(":"), number("line", 9), F.lit(":"), number("pos", 7)),
    }).drop("pos")


def rejects(sources: DataFrame) -> DataFrame:
    """``project, file`` of files of a known language that can't be parsed."""
    return _parsed(sources).where("failed").select("project", "file")


def extract_nodes(functions: DataFrame) -> DataFrame:
    """Graph nodes from declarations, in the order of file and line; tests by each language's rule. Of overloads, which share an id, the first."""
    from triage.operators.callgraph import csharp_is_test, java_is_test

    marked = F.max(F.col("name").startswith("test_") & (F.col("depth") <= 1)).over(Window.partitionBy("project", "file"))
    short = F.transform("annotations", lambda a: F.substring_index(a, ".", -1))
    is_test = F.when(F.col("lang") == "python", marked).when(F.col("lang") == "java", java_is_test(F.col("annotations")) | java_is_test(short)).otherwise(csharp_is_test(short, F.transform("type_annotations", lambda a: F.substring_index(a, ".", -1)), F.col("name")))
    out = functions.withColumn("is_test", F.coalesce(is_test, F.lit(False)))
    order = F.concat("file", F.lit(":"), F.lpad(F.col("line").cast("string"), 9, "0"))
    return out.select(
        "project", "node_id", F.when(F.col("is_test"), "test").otherwise("function").alias("type"), "lang", "file", F.col("line").alias("start_line"), "end_line", "is_test", "is_parametrized", "parameters", "return_type", "is_async",
        order.alias("node_ord"), "name", F.col("owner").alias("type_name"), "ns", "docstring",
    ).withColumn("_first", F.row_number().over(Window.partitionBy("project", "node_id").orderBy("node_ord", "parameters"))).where("_first = 1").drop("_first")


def path_docstrings(steps: DataFrame, functions: DataFrame) -> DataFrame:
    """``steps`` (project, node_id, ...) with the docstring of each function."""
    doc = functions.groupBy("project", "node_id").agg(F.min_by("docstring", "line").alias("docstring"))
    return steps.join(doc, ["project", "node_id"], "left").withColumn("docstring", F.coalesce("docstring", F.lit("")))


def project_languages(files: DataFrame) -> DataFrame:
    """``project, languages, language, extractor``: which languages a project has; first of py, java, cs; first of cs, java, py."""
    f = F.lower("file")
    got = files.groupBy("project").agg(*[F.bool_or(f.endswith(e)).alias(n) for n, e in (("python", ".py"), ("java", ".java"), ("csharp", ".cs"))])
    pick = lambda *names: F.coalesce(*[F.when(F.col(n), n) for n in names])
    return got.select("project", F.array_compact(F.array(*[F.when(F.col(n), n) for n in ("python", "java", "csharp")])).alias("languages"), pick("python", "java", "csharp").alias("language"), pick("csharp", "java", "python").alias("extractor"))
