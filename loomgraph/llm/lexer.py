"""Comments and string literals of source and configuration files, by one scanning expression per family of languages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_QUOTED = r'"(?:[^"\\\r\n]|\\.)*"'
_SINGLE = r"'(?:[^'\\\r\n]|\\.)*'"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
# fixed values: the token classes that can hide one another, per family
_SCAN = {
    "brace": re.compile(rf'(?P<text>"""[\s\S]*?(?:"""|\Z))|(?P<line>//[^\r\n]*)|(?P<block>{_BLOCK})|(?P<str>{_QUOTED})|(?P<chr>{_SINGLE})'),
    "python": re.compile(rf'(?P<text>"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z))|(?P<line>\#[^\r\n]*)|(?P<str>{_QUOTED}|{_SINGLE})', re.S),
    "sql": re.compile(rf"(?P<line>--[^\r\n]*)|(?P<block>{_BLOCK})|(?P<sql>'(?:[^']|'')*')|(?P<str>\"[^\"\r\n]*\")"),
    "hash": re.compile(rf"(?P<line>(?:(?<=\s)|^)\#[^\r\n]*)|(?P<str>{_QUOTED})|(?P<sql>'(?:[^'\r\n]|'')*')", re.M),
    "xml": re.compile(r"(?P<xml><!--[\s\S]*?(?:-->|\Z))|(?P<attr>=\s*(?:\"[^\"]*\"|'[^']*'))|(?P<body>>[^<>]+<)"),
}
_VALUE = re.compile(r"(?m)^[ \t]*(?:-[ \t]+)?(?:[\w.\-/]+[ \t]*[:=]|[\w.\-/]+[ \t]*:)?[ \t]*(?P<v>[^\s#\"'][^\r\n]*)\r?$")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " ", "0": " "}


def family(path: str | None, lang: str | None = None, text: str = "") -> str:
    """Scanning family from the path, else from the language mark, else from the text itself."""
    name = (path or "").strip().lower().replace("\\", "/").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext in ("kt", "kts", "java", "proto", "groovy", "gradle", "scala", "js", "ts", "go", "c", "cpp", "h", "rs", "swift"):
        return "brace"
    if ext in ("py", "pyi"):
        return "python"
    if ext == "sql":
        return "sql"
    if ext in ("yml", "yaml", "properties", "env", "conf", "ini", "toml", "sh", "cfg") or "dockerfile" in name or name.startswith(".env"):
        return "hash"
    if ext in ("xml", "html", "xhtml", "pom"):
        return "xml"
    known = {"kotlin": "brace", "java": "brace", "proto": "brace", "sql": "sql", "yaml": "hash"}
    if lang in known:
        return known[lang]
    if re.match(r"\s*<", text):
        return "xml"
    if re.search(r"(?m)^\s*(?:def |class \w+.*:\s*$|@\w+|import |from \w+ import)|\w = |\w\(", text):
        return "brace" if re.search(r"(?m)[;{]\s*$", text) else "python"
    return "hash"


def unescape(text: str) -> str:
    """Escapes of a string literal resolved; surrogate pairs become one character."""
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else _SIMPLE.get(m.group(3), m.group(3)), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def spans(text: str, kind: str) -> Iterator[tuple[str, int, int, str]]:
    """(class, start, end, content) with class ``comment`` or ``literal``; the content has no marks and no escapes."""
    covered = []
    for m in _SCAN[kind].finditer(text):
        what, raw = m.lastgroup, m.group()
        if kind == "hash":
            covered.append((m.start(), m.end()))
        if what == "line":
            yield "comment", m.start(), m.end(), raw.lstrip("/#-! ")
        elif what == "block":
            yield "comment", m.start(), m.end(), strip_marks(raw)
        elif what == "xml":
            yield "comment", m.start(), m.end(), html.unescape(raw[4:].removesuffix("-->"))
        elif what == "text":
            yield "literal", m.start(), m.end(), unescape(raw[3:-3] if len(raw) >= 6 else raw[3:])
        elif what == "str":
            yield "literal", m.start(), m.end(), unescape(raw[1:-1])
        elif what == "sql":
            yield "literal", m.start(), m.end(), raw[1:-1].replace("''", "'")
        elif what == "attr":
            yield "literal", m.start(), m.end(), html.unescape(raw.lstrip("= \t\r\n")[1:-1])
        elif what == "body" and raw[1:-1].strip():
            yield "literal", m.start(), m.end(), html.unescape(raw[1:-1])
    if kind == "hash":
        # bare values are string literals too
        rest = list(text)
        for a, b in covered:
            rest[a:b] = " " * (b - a)
        for m in _VALUE.finditer("".join(rest) if covered else text):
            if " " in m.group("v").strip():
                yield "literal", m.start("v"), m.end("v"), unescape(m.group("v"))


_OPEN = re.compile(r"^\s*(?:/\*+|\"\"\"|''')")
_CLOSE = re.compile(r"(?:\*+/|\"\"\"|''')\s*$")
_STAR = re.compile(r"(?m)^[ \t]*(?:\*+(?!\*)|//+[!/]?|\#+)[ \t]?(?!\w+\*\*)")


def strip_marks(text: str) -> str:
    """A comment without its opening, closing and line marks."""
    text = _CLOSE.sub("", _OPEN.sub("", text))
    return _STAR.sub("", text).strip()
