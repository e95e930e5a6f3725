"""Column functions over test names, messages, paths and code. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI = r"(?:\x1B|#x1B)\[[0-9;]*[A-Za-z]"

# Segments that name no class; file endings; words that start a shortened path.
IGNORED_SEGMENTS = ("src", "main", "test", "tests", "java", "csharp", "bin", "obj", "build", "target")
EXTENSIONS = {"python": ".py", "java": ".java", "csharp": ".cs"}
ANCHORS = ("tests", "src", "source", "app", "lib")
# Places of a file and a line in a message, in the order in which they are looked for.
LOCATION_PATTERNS = (
    r"([A-Za-z]:\\[^()\n]+\.(?:cs|vb))\((\d+)(?:,\d+)?\)",
    r"((?:\./)?[^()\n]+\.(?:cs|vb|java|py))\((\d+)(?:,\d+)?\)",
    r"\(([^():\n]+\.java):(\d+)\)",
    r'File\s+"([^"\n]+\.py)",\s+line\s+(\d+)',
    r"([A-Za-z]:\\[^:\n]+):(\d+)",
    r"((?:[^:\n]+\\)+[^:\n]+\.(?:py|java|cs)):(\d+)",
    r"(\\\\[^\n:]+):(\d+)",
    r"((?:\./)?[^:\n]+\.(?:py|java|cs)):(\d+)",
)
# Names of failure types that stand for another.
FAILURE_ALIASES = {
    "AssertionFailedError": "AssertionError",
    "ComparisonFailure": "AssertionError",
    "TimeoutException": "Timeout",
    "SocketTimeoutException": "Timeout",
    "RequestTimeout": "Timeout",
    "ConnectException": "Network",
    "ConnectionError": "Network",
    "HTTPError": "Network",
    "ConfigError": "Configuration",
    "ConfigurationError": "Configuration",
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def clean_text(c: Column) -> Column:
    """Null is ''. Ends are trimmed first, so blanks that an escape hid stay."""
    return strip_ansi(strip(F.coalesce(c, F.lit(""))))


def normalize_record(name: Column, status: Column, message: Column) -> list[Column]:
    return [clean_text(name).alias("name"), F.lower(clean_text(status)).alias("status"), clean_text(message).alias("message")]


def python_filepath(path: Column) -> Column:
    """Null and blank are ``unknown.py``. A name without a slash has its dots taken for slashes, ``x.py`` too."""
    p = F.replace(strip(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    slashed = F.when(~p.contains("/"), F.replace(p, F.lit("."), F.lit("/"))).otherwise(p)
    tidy = F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), "^/|/$", "")
    return F.when(p == "", "unknown.py").when(tidy.endswith(".py"), tidy).otherwise(F.concat(tidy, F.lit(".py")))


def split_name(raw: Column) -> Column:
    """struct(path, parts): cut at the first ``::``, else the first ``#``, else the last dot between two names."""
    s = F.replace(strip(F.coalesce(raw, F.lit(""))), F.lit("\\"), F.lit("/"))
    nonblank = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    cut = F.instr(s, "::")
    mark = F.instr(s, "#")
    last = F.substring_index(s, ".", -1)
    head = F.substring(s, F.lit(1), F.greatest(F.length(s) - F.length(last) - 1, F.lit(0)))
    dotted = s.contains(".") & (strip(last) != "") & (strip(head) != "")
    none = F.array().cast("array<string>")
    return (
        F.when(cut > 0, F.struct(strip(F.substring(s, F.lit(1), cut - 1)).alias("path"), nonblank(F.split(F.substring(s, cut + 2, F.length(s)), "::")).alias("parts")))
        .when(mark > 0, F.struct(strip(F.substring(s, F.lit(1), mark - 1)).alias("path"), nonblank(F.array(F.substring(s, mark + 1, F.length(s)))).alias("parts")))
        .when(dotted, F.struct(strip(head).alias("path"), F.array(strip(last)).alias("parts")))
        .otherwise(F.struct(s.alias("path"), none.alias("parts")))
    )


def normalize_test_name(raw: Column, lang: str) -> Column:
    """``file::parts`` for Python, ``Class.ext::Class::parts`` else; null and '' stay."""
    return F.when(raw == "", raw).when(raw.isNotNull(), let(split_name(raw), lambda both: _joined(both["path"], both["parts"], lang)))


def _joined(path: Column, parts: Column, lang: str) -> Column:
    if lang.lower() == "python":
        name = F.array_join(F.concat(F.array(python_filepath(path)), parts), "::")
    else:
        segments = F.filter(F.split(F.replace(path, F.lit("."), F.lit("/")), "/+"), lambda x: x != "")
        core = F.filter(segments, lambda x: ~F.lower(x).isin(*IGNORED_SEGMENTS))
        base = F.substring_index(path, "/", -1)
        stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
        is_file = F.lower(path).endswith(".java") | F.lower(path).endswith(".cs")
        owner = F.when(is_file, F.coalesce(blank_to_null(stem), F.lit("Unknown"))).otherwise(F.coalesce(F.try_element_at(core, F.lit(-1)), F.try_element_at(segments, F.lit(-1)), F.lit("Unknown")))
        file = F.concat(owner, F.lit(EXTENSIONS.get(lang.lower(), "")))
        name = F.array_join(F.when(F.size(parts) > 0, F.concat(F.array(file, owner), parts)).otherwise(F.array(file)), "::")
    return name


def strip_param_suffix(c: Column) -> Column:
    """Without all ``[..]`` and ``(..)`` at the end."""
    return F.regexp_replace(c, r"(?:\[[^\]]*\]|\([^\)]*\))+$", "")


def strip_params(c: Column) -> Column:
    """Without one ``[..]``, ``(..)`` or ``{..}`` at the end."""
    return strip(F.regexp_replace(c, r"(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})$", ""))


def last_token(c: Column) -> Column:
    """What follows the last ``::``; all of it if there is none."""
    return F.substring_index(c, "::", -1)


def extract_file_lines(message: Column) -> Column:
    """array<struct<path, line>> of all matches, pattern after pattern; null and '' give an empty array."""
    found = [
        F.zip_with(F.regexp_extract_all(message, F.lit(p), F.lit(1)), F.regexp_extract_all(message, F.lit(p), F.lit(2)), lambda a, b: F.struct(strip(a).alias("path"), b.cast("int").alias("line")))
        for p in LOCATION_PATTERNS
    ]
    return F.coalesce(F.filter(F.concat(*found), lambda x: x["line"].isNotNull()), F.array().cast("array<struct<path:string,line:int>>"))


def chain_plain(c: Column) -> Column:
    """A path with ``>`` between its segments and at neither end."""
    chain = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit(">")), F.lit("/"), F.lit(">")), F.lit("::"), F.lit(">"))
    return strip(F.regexp_replace(F.regexp_replace(chain, ">+", ">"), r"^\s*>|>\s*$", ""))


def path_chain(c: Column) -> Column:
    """The same without a drive, from the first anchor segment on."""

    def cut(chain: Column) -> Column:
        parts = F.filter(F.split(chain, ">"), lambda x: x != "")
        anchors = lambda p: F.filter(F.transform(p, lambda x, i: F.when(x.isin(*ANCHORS), i)), lambda i: i.isNotNull())
        return let(parts, lambda p: let(F.try_element_at(anchors(p), F.lit(1)), lambda first: F.when(first.isNotNull(), F.array_join(F.slice(p, first + 1, F.greatest(F.size(p), F.lit(1))), ">")).otherwise(chain)))

    return let(F.regexp_replace(chain_plain(c), "^[A-Za-z]:>", ""), cut)


def tail_key(c: Column, n: int = 4) -> Column:
    """The last n ``>`` segments."""
    parts = F.filter(F.split(c, ">"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ">")


def dedupe_by_tail(a: Column, n: int = 4) -> Column:
    """Keeps the first of all elements with the same last n segments."""
    keyed = F.transform(a, lambda x: F.struct(x.alias("x"), tail_key(x, n).alias("k")))
    once = lambda s: F.filter(s, lambda e, i: F.array_position(F.transform(s, lambda y: y["k"]), e["k"]) == i + 1)
    return F.transform(let(keyed, once), lambda e: e["x"])


def locate(message: Column) -> Column:
    """struct(heuristic, raw_paths): shortened chains and plain ``path:line``, each without repeats."""

    def both(found: Column) -> Column:
        chains = F.filter(F.transform(found, lambda x: F.struct(path_chain(x["path"]).alias("c"), x["line"].alias("l"))), lambda x: x["c"] != "")
        heuristic = F.transform(chains, lambda x: F.concat(x["c"], F.lit(">"), x["l"].cast("string")))
        raw = F.transform(found, lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string")))
        return F.struct(dedupe_by_tail(heuristic).alias("heuristic"), dedupe_by_tail(raw).alias("raw_paths"))

    return let(extract_file_lines(message), both)


def norm_failure_type(c: Column) -> Column:
    """The last dotted part, aliases replaced; null is ''."""
    last = F.substring_index(strip(F.coalesce(c, F.lit(""))), ".", -1)
    return reduce(lambda acc, kv: acc.when(last == kv[0], kv[1]), FAILURE_ALIASES.items(), F.when(F.lit(False), "")).otherwise(last)


def derived_failure_type(given: Column, error: Column) -> Column:
    """The given type, else what stands before the first colon of the error; '' if neither says anything."""
    return F.coalesce(blank_to_null(norm_failure_type(given)), norm_failure_type(strip(F.substring_index(F.coalesce(error, F.lit("")), ":", 1))))


def failure_type(given: Column, error: Column) -> Column:
    return F.coalesce(blank_to_null(derived_failure_type(given, error)), F.lit("Other"))


def qualified_split(raw: Column) -> Column:
    """struct(owner, method) of a qualified test name."""
    parts = F.filter(F.transform(F.split(raw, "::"), strip), lambda x: x != "")
    dots = F.filter(F.transform(F.split(raw, r"\."), strip), lambda x: x != "")
    mark = F.instr(raw, "#")
    pair = lambda a: F.struct(F.try_element_at(a, F.lit(-2)).alias("owner"), F.try_element_at(a, F.lit(-1)).alias("method"))
    return (
        F.when(raw.contains("::") & (F.size(parts) >= 2), pair(parts))
        .when(mark > 0, F.struct(F.substring_index(strip(F.substring(raw, F.lit(1), mark - 1)), ".", -1).alias("owner"), strip(F.substring(raw, mark + 1, F.length(raw))).alias("method")))
        .when(F.size(dots) >= 2, pair(dots))
        .otherwise(F.struct(F.lit("UnknownClass").alias("owner"), raw.alias("method")))
    )


def guess_target(name: Column, lang: str) -> Column:
    """struct(func, file): the function and file a test's name speaks of."""
    clean = strip_params(name)
    both = qualified_split(clean)
    owner, method = both["owner"], both["method"]
    if lang == "csharp":
        simple = F.substring_index(owner, ".", -1)
        return F.struct(F.concat_ws("::", simple, method).alias("func"), F.concat(simple, F.lit(".cs")).alias("file"))
    if lang == "java":
        head = F.regexp_replace(F.regexp_replace(clean, "(::|#).*$", ""), r"\.java$", "")
        dotted = F.when(clean.contains("::") | clean.contains("#"), head).otherwise(F.regexp_replace(clean, r"\.[^.]*$", ""))
        return F.struct(F.concat_ws("::", owner, method).alias("func"), F.concat(F.replace(dotted, F.lit("."), F.lit("/")), F.lit(".java")).alias("file"))
    cut = F.instr(clean, ".py::")
    file = F.when(cut > 0, F.substring(clean, F.lit(1), cut + 2)).otherwise(python_filepath(split_name(clean)["path"]))
    func = F.when(cut > 0, F.substring(clean, cut + 5, F.length(clean))).otherwise(F.array_join(split_name(clean)["parts"], "::"))
    return F.struct(func.alias("func"), file.alias("file"))


def file_from_func_id(c: Column) -> Column:
    """The first part of an id, or the second if the first is a namespace in angle brackets."""
    parts = F.split(c, "::")
    return F.when(parts[0].startswith("<"), F.try_element_at(parts, F.lit(2))).otherwise(parts[0])


def external_simple_name(c: Column) -> Column:
    """An external's id without its kind and its argument count."""
    return F.regexp_replace(F.regexp_replace(c, "^(?:external|project|nuget)::", ""), r"/\d+$", "")


def test_label(c: Column) -> Column:
    return last_token(strip(F.coalesce(c, F.lit(""))))


def stable_hash(c: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def language_of(file: Column) -> Column:
    return F.when(file.endswith(".py"), "python").when(file.endswith(".java"), "java").when(file.endswith(".cs"), "csharp")


def candidate_file(c: Column) -> Column:
    return F.regexp_replace(c, r">\d+$", "")


def snippet(code: Column, n: int = 10) -> Column:
    """The first n lines, and a mark if there are more."""
    lines = F.split(F.coalesce(code, F.lit("")), "\n")
    head = F.slice(lines, 1, n)
    return F.array_join(F.when(F.size(lines) > n, F.concat(head, F.array(F.lit("    ...")))).otherwise(head), "\n")


def console_counts(text: Column) -> Column:
    """struct(total, failed, passed, lines) from raw runner output."""
    t = F.coalesce(text, F.lit(""))
    total, failed = F.regexp_count(t, F.lit("test_")), F.regexp_count(t, F.lit("FAIL"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.contains("FAIL:") | x.contains("Traceback"))
    return F.struct(total.alias("total"), failed.alias("failed"), (total - failed).alias("passed"), lines.alias("lines"))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


# Folders whose code isn't the project's own.
FOREIGN_FOLDERS = ("venv", "env", ".venv", ".tox", "site-packages", "dist-packages", ".pytest_cache", "__pycache__")


def keep_step(file: Column) -> Column:
    """Whether a step lies in the project's own code; a step without a file does."""
    path = F.concat(F.lit("/"), F.lower(F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/"))))
    return ~reduce(lambda a, b: a | b, [path.contains(f"/{x}/") for x in FOREIGN_FOLDERS])


def rationale(c: Column) -> Column:
    """A ``reasoning`` key in JSON text is called ``rationale``."""
    return F.regexp_replace(c, "[\"']reasoning[\"']\\s*:", '"rationale":')
