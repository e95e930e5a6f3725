"""Records of one test-result file: what a task does with the bytes of a file, or of a part of one.

A file is cut into its record elements and each of these is parsed by itself, so a record that isn't well formed is
one reject and the others stay. Every kind of record that a file may hold is found in one pass; the dialect is then that with most named ones.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from typing import NamedTuple

# Of two dialects that find as many records, the one with the lower number is chosen.
PRIORITY = {"xunit": 5, "pytest": 10, "nunit": 12, "trx": 15, "json": 90, "universal": 99, "junit": 100}
#: Elements that are records, and what they are records of.
RECORD_TAGS = {"testcase": "junit", "test-case": "nunit", "test": "xunit", "unittestresult": "trx", "unittest": "definition"}


class Record(NamedTuple):
    dialect: str
    ord: int  # where it begins, or its place in a list
    name: str
    status: str
    message: str


class Reject(NamedTuple):
    ord: int | None  # None: the whole file
    reason: str


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([A-Za-z_][\w.:-]*)((?:\s+[^\s=<>\"'/]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*)(/?)>", re.S)
_RECORD_START = re.compile(r"<(?:[\w.-]+:)?(testcase|test-case|unittestresult|unittest|test)(?=[\s/>])", re.I)
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower()


def _tidy(text: str | None) -> str:
    return (text or "").strip()


def _first(*texts: str | None) -> str:
    return next((t for t in texts if _tidy(t)), None) or ""


def element(text: str) -> ElementTree.Element:
    """The element that a piece of a document is; prefixes needn't be declared in it."""
    names = "".join(f' xmlns:{p}="{p}"' for p in dict.fromkeys(_PREFIX.findall(text)) if p not in ("xml", "xmlns"))
    return ElementTree.fromstring(f"<r{names}>{text}</r>")[0]


def _fields(e: ElementTree.Element) -> tuple[dict[str, str], dict[str, list[ElementTree.Element]]]:
    children: dict[str, list[ElementTree.Element]] = {}
    for c in e:
        children.setdefault(_local(c.tag), []).append(c)
    return {_local(k): v for k, v in e.attrib.items()}, children


def _said(children: dict, *kinds: str) -> ElementTree.Element | None:
    return next((children[k][0] for k in kinds if k in children), None)


def _outcome(result: str | None) -> str:
    r = (result or "").lower()
    return "failed" if r.startswith("fail") else "skipped" if r.startswith("skip") or r == "inconclusive" else "passed"


def junit(e: ElementTree.Element) -> tuple[str, str, str]:
    own, children = _fields(e)
    said = _said(children, "failure", "error", "skipped")
    status = "failed" if "failure" in children or "error" in children else "skipped" if "skipped" in children else "passed"
    parts = [] if said is None else [said.get("message"), said.text, *[m.text for m in said if _local(m.tag) == "message"]]
    name = own.get("name", "")
    return f"{own['classname']}::{name}" if own.get("classname") else name, status, "\n".join(_tidy(p) for p in parts if _tidy(p))


def _failure(children: dict) -> str:
    said = _said(children, "failure")
    return "" if said is None else _first(*[m.text for m in said if _local(m.tag) == "message"][:1], said.get("message"), said.text)


def nunit(e: ElementTree.Element) -> tuple[str, str, str]:
    own, children = _fields(e)
    name = _first(own.get("fullname")) or ".".join(own[k] for k in ("classname", "name") if k in own).strip(".")
    return name, _outcome(own.get("result")), _failure(children)


def xunit(e: ElementTree.Element) -> tuple[str, str, str] | None:
    """None: a ``test`` of another kind, or without a name."""
    own, children = _fields(e)
    if "result" not in own and "type" not in own:
        return None
    name = _first(own.get("name"), ".".join(own[k] for k in ("type", "method") if k in own).strip("."))
    return (name, _outcome(own.get("result")), _failure(children)) if name else None


def trx(e: ElementTree.Element, definitions: dict[str, str]) -> tuple[str, str, str]:
    own, _ = _fields(e)
    outcome = own.get("outcome", "").lower()
    status = "failed" if outcome == "failed" else "skipped" if outcome in ("notexecuted", "skipped", "inconclusive") else "passed"
    path, said = ("output", "errorinfo", "message"), e
    for step in path:
        said = next((c for c in said if _local(c.tag) == step), None) if said is not None else None
    message = (said.text or "") if said is not None and status == "failed" else ""
    return _first(definitions.get(own.get("testid", "")), own.get("testname")), status, message


def definition(e: ElementTree.Element) -> tuple[str, str] | None:
    own, children = _fields(e)
    if "id" not in own:
        return None
    method = _said(children, "testmethod")
    of = {} if method is None else _fields(method)[0]
    return own["id"], ".".join(of[k] for k in ("classname", "name") if _tidy(of.get(k)))


def universal(root: ElementTree.Element) -> list[tuple[str, str, str]]:
    """(name, status, message) of the elements of a document of unknown kind that look like tests, in document order."""
    elements = list(root.iter())
    groups = (
        [e for e in elements if _local(e.tag).endswith(("testcase", "test-case"))],
        [e for e in elements if _local(e.tag).endswith("test") and e.get("result") is not None],
        [e for e in elements if e.get("fullname") or e.get("name")],
    )
    out = []
    for e in next((g for g in groups if g), []):
        own = {_local(k): v for k, v in e.attrib.items()}
        children = {_local(c.tag): c for c in reversed(list(e))}
        said = children.get("failure") if "failure" in children else children.get("error")
        status = own.get("result") or own.get("status") or own.get("outcome") or ("failed" if said is not None else "skipped" if "skipped" in children else "passed")
        low = status.lower()
        status = "failed" if low.startswith("fail") or low == "error" else "skipped" if low.startswith(("skip", "ignore", "notexec", "inconcl")) else "passed" if low in ("success", "ok", "pass", "passed") else low
        inner = said if said is not None else children.get("message")
        message = "" if inner is None else inner.get("message") or " ".join("".join(inner.itertext()).split())
        out.append((own.get("fullname") or own.get("name") or "", status, message))
    return out


def _decoded(content: bytes) -> str:
    """The text as characters of one byte each, UTF-8 inside; documents in other encodings are written anew in that."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        content = content.decode("utf-16", "replace").encode()
    else:
        named = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([\w.:-]+)""", content[:200].removeprefix(b"\xef\xbb\xbf"))
        if named and named[1].decode().lower() not in ("utf-8", "utf8", "us-ascii"):
            try:
                content = content.decode(named[1].decode(), "replace").encode()
            except LookupError:
                pass
    return content.decode("latin-1")


def _text(piece: str) -> str:
    return piece.encode("latin-1").decode("utf-8", "replace")


def spans(text: str, begin: int = 0, end: int | None = None) -> tuple[list[tuple[int, int, str]], list[Reject], set[str]]:
    """(records, rejects, tags): where the record elements that begin in [begin, end) lie, as (first, stop, tag), in order; those without an end; all element names met.

    A record within a record is one of its own. A record whose own tag can't be read, or that is never closed, is a reject, and the reading goes on after its tag.
    """
    end = len(text) if end is None else end
    found, rejects, tags, open_ = [], [], set(), []
    place = begin
    while True:
        m = _MARKUP.search(text, place)
        # a record's tag that isn't well formed is no markup: it stands in what is skipped
        for bad in _RECORD_START.finditer(text, place, len(text) if m is None else m.start()):
            if open_ or bad.start() < end:
                rejects.append(Reject(bad.start(), f"the tag of a {bad[1].lower()} can't be read"))
        if m is None or (not open_ and m.start() >= end):
            break
        place = m.end()
        if not m[2]:
            continue
        tag = _local(m[2])
        tags.add(tag)
        if tag not in RECORD_TAGS:
            continue
        if m[1]:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][1] == tag), None)
            if at is not None:
                rejects.extend(Reject(o, f"a {t} isn't closed") for o, t in open_[at + 1 :])
                found.append((open_[at][0], m.end(), tag))
                del open_[at:]
        elif m[4]:
            found.append((m.start(), m.end(), tag))
        elif m.start() < end:
            open_.append((m.start(), tag))
    rejects.extend(Reject(o, f"a {t} isn't closed") for o, t in open_)
    return sorted(found), rejects, tags


def xml_records(content: bytes, end: int | None = None, only: str | None = None) -> tuple[list[Record], list[Reject]]:
    """Records of an XML file in its dialect, or in the dialect ``only``; with ``end`` of those that begin before it."""
    text = _decoded(content)
    found, rejects, tags = spans(text, 0, end)
    records: dict[str, list[Record]] = {}
    definitions: dict[str, str] = {}
    elements: list[tuple[int, str, ElementTree.Element]] = []
    for first, stop, tag in found:
        try:
            elements.append((first, RECORD_TAGS[tag], element(_text(text[first:stop]))))
        except ElementTree.ParseError as e:
            rejects.append(Reject(first, f"{tag}: {e}"))
    for _, kind, e in elements:
        if kind == "definition" and (d := definition(e)):
            definitions[d[0]] = d[1]
    for first, kind, e in elements:
        got = junit(e) if kind == "junit" else nunit(e) if kind == "nunit" else xunit(e) if kind == "xunit" else trx(e, definitions) if kind == "trx" else None
        if got and only in (None, kind):
            records.setdefault(kind, []).append(Record(kind, first, *got))
    if only in (None, "universal") and end is None and not tags & {"testcase", "test-case", "unittestresult"} and not tags >= {"test", "collection"}:
        try:
            rows = universal(ElementTree.fromstring(_text(text).removeprefix("﻿").encode() if "encoding" not in text[:200] else re.sub(r"^\s*<\?xml.*?\?>", "", _text(text).removeprefix("﻿"), flags=re.S)))
        except ElementTree.ParseError as e:
            rows = []
            if not records:
                rejects.append(Reject(None, str(e)))
        if rows:
            records["universal"] = [Record("universal", i, *r) for i, r in enumerate(rows)]
    return records.get(only, []) if only else _chosen(records, "universal"), sorted(rejects, key=lambda r: (r.ord is not None, r.ord or 0))


def _chosen(records: dict[str, list[Record]], otherwise: str) -> list[Record]:
    """Those of the dialect with most named records; ties go to the lower priority, no name at all to ``otherwise``."""
    named = {d: sum(bool(_tidy(r.name)) for r in rows) for d, rows in records.items()}
    best = min(named, key=lambda d: (-named[d], PRIORITY[d]), default=otherwise)
    return records.get(best if named.get(best) else otherwise, [])


def _value(v: object) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _loose_items(text: str) -> tuple[list[tuple[int, object]], list[Reject]]:
    """The objects of a list in a text that isn't JSON as a whole; where one can't be read, the next one that follows a comma is tried."""
    begin = re.search(r'"tests"\s*:\s*\[|^\s*\[', text)
    items, rejects = [], []
    if not begin:
        return items, rejects
    place, decoder = begin.end(), json.JSONDecoder()
    while nxt := re.compile(r"[^\s,]").search(text, place):
        if nxt[0] == "]":
            break
        try:
            value, place = decoder.raw_decode(text, nxt.start())
            items.append((nxt.start(), value))
        except ValueError as e:
            rejects.append(Reject(nxt.start(), str(e)))
            again = re.compile(r"\}\s*,\s*(?=\{)").search(text, nxt.start() + 1)
            if not again:
                break
            place = again.end()
    return items, rejects


def json_records(content: bytes, only: str | None = None) -> tuple[list[Record], list[Reject]]:
    """Records of a JSON file, whose lists are ``tests``, ``report.tests`` or the whole; items that are no objects are rejects."""
    try:
        text = content.decode("utf-8-sig")
        value = json.loads(text)
        inner = value.get("report") if isinstance(value, dict) else None
        lists = [v for v in ((value.get("tests"), inner.get("tests") if isinstance(inner, dict) else None) if isinstance(value, dict) else (value,)) if isinstance(v, list)]
        if not lists:
            return [], [Reject(None, "no list of tests")]
        items, rejects, whole = list(enumerate(lists[0])), [], isinstance(value, list)
    except ValueError as e:
        items, rejects = _loose_items(content.decode("utf-8", "replace"))
        whole = True
        if not items:
            return [], [Reject(None, str(e))]
    records: dict[str, list[Record]] = {"pytest": [], "json": []}
    for k, item in items:
        if not isinstance(item, dict):
            rejects.append(Reject(k, "a record that is no object"))
            continue
        pick = lambda *names: _first(*[_value(item.get(n)) for n in names])  # noqa: E731, B023
        if _tidy(name := pick("nodeid", "name")):
            records["pytest"].append(Record("pytest", k, name, pick("outcome", "status"), pick("longrepr", "message")))
        if whole:
            records["json"].append(Record("json", k, pick("name"), pick("status"), pick("message")))
    return records.get(only, []) if only else _chosen(records, "pytest"), sorted(rejects, key=lambda r: r.ord or 0)


def file_records(name: str, content: bytes, only: str | None = None) -> tuple[list[Record], list[Reject]]:
    """(records, rejects) of a whole file, in its own dialect or in ``only``; a file without any record and without a reject is one."""
    records, rejects = json_records(content, only) if name.lower().endswith(".json") else xml_records(content, only=only)
    if not records and not rejects:
        rejects = [Reject(None, "no record")]
    return records, rejects


def split_dialect(name: str, head: bytes) -> str | None:
    """The dialect in which a file can be read in parts, by its first record: None for those that need the whole file."""
    if not name.lower().endswith(".xml") or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return None
    named = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([\w.:-]+)""", head[:200].removeprefix(b"\xef\xbb\xbf"))
    first = _RECORD_START.search(re.sub(r"<!--.*?-->", "", head.decode("latin-1"), flags=re.S))
    kind = RECORD_TAGS[first[1].lower()] if first else None
    return kind if kind in ("junit", "nunit", "xunit") and (not named or named[1].lower() in (b"utf-8", b"utf8", b"us-ascii")) else None
