"""Functions paired with their documentation.

Method: a signature is detected by an expression of its language; the body is delimited by a stack, of braces where the
language has them, of indentation in Python, and of opening and ``end`` keywords in SQL functions and scripts; of the
documentation comments above the signature the one nearest in lines is attached if only annotations, comments and blank
lines lie between, in Python the string that opens the body.  Every step takes time in proportion to the file.

A documentation counts unless it is trivial: blank, only marks, markup, tags or references without a description, code,
a repetition of the function's name, a licence notice, or the announcement that text is still to be written or was generated.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import lexer

KINDS = ("METHOD", "ENDPOINT", "JOB", "TEST")

_KOTLIN = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|override|open|abstract|final|suspend|inline|operator|infix|tailrec|external|actual|expect|data)[ \t]+)*fun[ \t]*(?:<[^>\r\n]*>[ \t]*)?(?:[\w.<>?]+\.)?(?P<name>\w+|`[^`]+`)[ \t]*\(")
_JAVA = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>\r\n]*>[ \t]*)?(?!return\b|new\b|else\b|throw\b|case\b)[\w.<>\[\],? ]+?[ \t]+(?P<name>\w+)[ \t]*\([^;{}\r\n]*\)?[^;{}\r\n]*\{?[ \t]*\r?$")
_PYTHON = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*\(")
_DOCSTRING = re.compile(r"(?:[ \t]*(?:\#[^\r\n]*)?\r?\n)*[ \t]*(?P<doc>[rRuUbBfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'))")
_KEYWORD = re.compile(r"(?im)^[ \t]*(?:create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure)[ \t]+(?P<sql>[\w.\"]+)|def[ \t]+(?P<ruby>[\w.?!]+)|(?:function[ \t]+)?(?P<shell>[A-Za-z_]\w*)[ \t]*\(\)[ \t]*\{?)")
# fixed values: words that open a block and words that close one
_OPENS = re.compile(r"(?i)\$\w*\$|'(?:[^']|'')*'|--[^\r\n]*|(?<![\w.])\#[^\r\n]*|\b(?:begin|case|loop|do|if|while|until|for|unless|class|module|def|end(?:[ \t]+(?:if|loop|case|while))?|fi|done|esac)\b|[{}]")


def _end_of_call(text: str, at: int) -> int:
    """Position behind the bracket that closes the one at ``at``, strings and comments left out."""
    depth = 0
    for m in re.finditer(r"[()\[\]{}]|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'", text[at:]):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return at + m.end()
    return len(text)


_SCAN = re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|[{}]|\r?\n|=(?!=)|;")
_GOES_ON = re.compile(r"\s*(?:[{=.]|throws|where)")


def _brace_body(text: str, at: int) -> int:
    """End of the body that opens at or behind ``at``; an expression body ends with its line."""
    stack = 0
    for m in _SCAN.finditer(text, at):
        c = m.group()
        if c == "{":
            stack += 1
        elif c == "}":
            stack -= 1
            if stack <= 0:
                return m.end()
        elif stack == 0 and c in ("\n", "\r\n", ";") and not _GOES_ON.match(text, m.end()):
            return m.start()
    return len(text)


def _indent_bodies(text: str, found: list[tuple[int, int, int]]) -> list[int]:
    """Ends of functions given as (start, end of the signature, indent), in order: a stack of open indents over the lines.

    A line that is not blank closes every open function it is not indented deeper than; lines inside a signature close none.
    """
    ends, stack, k = [len(text)] * len(found), [], 0
    for m in re.finditer(r"(?m)^([ \t]*)(?=\S)", text):
        width = len(m.group(1).expandtabs(4))
        while stack and m.start() >= found[stack[-1]][1] and width <= found[stack[-1]][2]:
            ends[stack.pop()] = m.start()
        while k < len(found) and found[k][0] <= m.end():
            stack.append(k)
            k += 1
    return ends


def _keyword_body(text: str, at: int) -> int:
    """End of a body whose blocks end by keyword: a stack of opening words; quoted bodies end with their quote."""
    stack: list[str] = []
    last = ""
    for m in _OPENS.finditer(text, at):
        word = " ".join(m.group().lower().split())
        if word[0] in "'-#" or word in ("if", "while", "for", "until", "unless", "loop", "case") and re.fullmatch(r"[ \t]*end[ \t]+", text[max(0, m.start() - 8) : m.start()].lower()):
            continue
        if word[0] == "$":
            if stack and stack[-1] == word:
                stack.pop()
                if not stack:
                    return m.end()
            else:
                stack.append(word)
        elif stack and stack[0][0] == "$":
            continue  # inside a quoted body only its quote counts
        elif word in ("}", "fi", "done", "esac") or word.startswith("end"):
            if stack:
                stack.pop()
            if not stack:
                return m.end()
        elif word == "do" and last in ("while", "until", "for"):
            last = ""  # belongs to the loop that is open
            continue
        else:
            stack.append(word)
        last = word
    return len(text)


def functions(text: str, kind: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(name, start, end, documentation comment or None) of each function outside others."""
    if kind == "python":
        heads = []
        for m in _PYTHON.finditer(text):
            if heads and m.start() < heads[-1][1]:
                continue
            closed = _end_of_call(text, m.end() - 1)
            colon = text.find(":", closed)
            heads.append((m.start(), len(text) if colon < 0 else colon + 1, len(m.group("indent").expandtabs(4)), m.group("name")))
        floor = 0
        for (start, colon, _, name), end in zip(heads, _indent_bodies(text, [h[:3] for h in heads])):
            if start < floor:
                continue
            doc = _DOCSTRING.match(text, colon)
            floor = max(end, colon)
            yield name, start, floor, doc.group("doc") if doc else None
        return
    found = list(lexer.spans(text, "sql" if kind == "sql" else "brace" if kind == "brace" else "python"))
    starts, ends = [a for _, a, _, _ in found], [b for _, _, b, _ in found]
    hidden = lambda at: (k := bisect_right(starts, at) - 1) >= 0 and at < ends[k]
    blocks = [(a, b) for c, a, b, _ in found if c == "comment"]
    if kind in ("sql", "hash"):
        floor = 0
        for m in _KEYWORD.finditer(text):
            name = m.group("sql") or m.group("ruby") or m.group("shell")
            if m.start() < floor or hidden(m.start(m.lastgroup)):
                continue
            end = _keyword_body(text, m.start() if m.group("ruby") else m.end() - m.group().endswith("{"))
            yield name.strip('"').rsplit(".", 1)[-1], m.start(), end, _lines_above(text, m.start(), floor)
            floor = max(end, m.end())
        return
    matches = {p: p.finditer(text) for p in (_KOTLIN, _JAVA)}
    ahead = {p: next(ms, None) for p, ms in matches.items()}
    at = 0
    while True:
        for p, ms in matches.items():
            while ahead[p] and (ahead[p].start("name") < at or hidden(ahead[p].start("name"))):
                ahead[p] = next(ms, None)
        heads = [m for m in ahead.values() if m]
        if not heads:
            return
        m = min(heads, key=lambda x: (x.start(), x.re is _JAVA))
        end = _brace_body(text, m.end("name"))
        yield m.group("name").strip("`"), m.start(), end, _attached(text, m.start(), at, blocks)
        at = max(end, m.end())


_BETWEEN = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\r\n]*|@[\w.:]+(?:\s*\((?:[^()\"]|\"(?:[^\"\\]|\\.)*\"|\([^()]*\))*\))?)*")


def _attached(text: str, start: int, floor: int, blocks: list[tuple[int, int]]) -> str | None:
    """The documentation comment above ``start`` that is nearest in lines, with only annotations, comments and blanks between."""
    k = bisect_right(blocks, (start, start)) - 1
    while k >= 0 and blocks[k][0] >= floor:
        a, b = blocks[k]
        k -= 1
        if b > start:
            continue
        if text.startswith("/**", a) and not text.startswith("/**/", a):
            return text[a:b] if _BETWEEN.fullmatch(text, b, start) else None
    return None


def _lines_above(text: str, start: int, floor: int) -> str | None:
    """The comment lines or the block comment that end right above ``start``."""
    m = re.search(r"(?:(?:^[ \t]*(?:--|\#)[^\r\n]*\r?\n)+|/\*[\s\S]*?\*/\s*)\Z", text[floor:start], re.M)
    return m.group().strip() if m else None


# fixed values: tags whose rest is no description, phrases that announce a text, words that stand for none
_NO_TEXT = {"author", "since", "see", "version", "hide", "inheritdoc", "suppress", "date", "generated", "link", "deprecated_since", "serial", "ignore", "internal"}
_LICENCE = re.compile(r"(?i)copyright|\blicen[cs]e|licen[cs]ed under|all rights reserved|spdx-|may be copied|redistribut|лицензи|авторски[ех] прав|lizenz|licencia\b|droits r[ée]serv")
_OPENING = re.compile(r"(?i)copyright|licen[cs]ed under|all rights reserved|spdx-|лицензи|авторски[ех] прав|droits r[ée]serv")
_TO_COME = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|tbd|tbc|wip)\b|(?:will|shall|must|should|needs? to|to) be (?:added|written|documented|described|filled|provided|completed|supplied)|(?:added|documented|written) later|auto[- ]?generated|generated (?:by|from|method|code|stub|automatically|comment)|created (?:by|from) (?:a )?template|method stub|"
    r"по шаблону|будет (?:добавлен|написан|дополнен|описан)|автоматически|сгенерирован|нужно (?:описать|дописать|добавить)|описание (?:позже|появится)|"
    r"automatisch (?:erzeugt|generiert|erstellt)|(?:wird|werden) (?:noch|später|nachgereicht|ergänzt)|aus (?:der|einer) vorlage|se (?:añadirá|agregará|completará)|generado (?:automáticamente|por)|plantilla|sera (?:ajout|compl|rédig)|généré|modèle automatique|à (?:compléter|documenter|rédiger)|por (?:documentar|completar)|noch zu (?:schreiben|dokumentieren)"
)
_NOTHING = {"none", "tbd", "n/a", "na", "no comment", "no comments", "see code", "see the code", "see above", "см код", "см. код", "см выше", "без комментариев", "нет", "нет описания", "docs", "doc", "empty", "description", "no description", "siehe code", "keine", "voir le code", "ver código", "sin comentarios", "sans commentaire", "ohne kommentar"}
_FILLER = {"the", "a", "an", "this", "that", "of", "to", "for", "method", "function", "and", "is", "it", "test", "tests", "endpoint", "job", "in", "on", "by", "метод", "функция", "этот", "эта", "для", "die", "der", "das", "den", "methode", "funktion", "el", "la", "los", "las", "método", "función", "le", "les", "un", "une", "une", "méthode", "fonction", "de", "del", "du", "des"}
_TAG = re.compile(r"^\s*(?:@|:)(?P<tag>[A-Za-z]\w*)(?:\[[^\]]*\])?\s*(?P<rest>.*)$", re.S)
_CODE = re.compile(r"^\s*(?:val|var|let|const|final|return|if|for|while|throw|import|public|private|def|fun|int|long|string|new|this\.|self\.)\b.*[=({;]|^\s*[\w.]+\s*(?:\([^)]*\))?\s*(?:[+\-*/]?=|;)\s*\S|^\s*[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?\s*$|[;{}]\s*$|^\s*(?:select|insert|update|delete)\s.*\b(?:from|into|set)\b.*[=;*]")
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[A-ZА-ЯЁ]+(?![a-zа-яё])|[A-ZА-ЯЁ]?[a-zà-öø-ÿа-яё]+|[^\W\d_]+")


def clean(doc: str | None) -> str:
    """A documentation without comment marks, markup and entities; line structure kept."""
    if not doc:
        return ""
    text = doc.replace("\r\n", "\n").strip()
    text = re.sub(r"^[rRuUbBfF]{0,2}(?=\"|')", "", text)
    text = lexer.strip_marks(text)
    while re.match(r"\s*/\*\*", text):
        text = lexer.strip_marks(text)
    text = text.strip("\"'") if re.match(r"^([\"'])[\s\S]*\1$", text) else text
    text = re.sub(r"<!--[\s\S]*?-->|</?[A-Za-z][^<>]*>", " ", text)
    text = html.unescape(text)
    text = re.sub(r"\{@(?:inheritDoc|hide|suppress)\}", " ", text, flags=re.I)
    text = re.sub(r"\{@\w+\s+([^{}]*)\}", r"\1", text)
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def _notice(text: str) -> bool:
    """Whether a text is a licence notice: it opens like one, or most of its paragraphs speak of it."""
    parts = [p for p in re.split(r"\n\s*\n|(?<=[.!?])\s+", text) if _WORD.search(p)]
    told = [bool(_LICENCE.search(p)) for p in parts]
    return not parts or bool(_OPENING.search(parts[0])) or 2 * sum(told) >= len(told) or bool(re.match(r"(?is).*?(?:this|that) file\b", parts[0]))


def description(doc: str | None) -> str:
    """What a documentation says in running text: without tags that carry none, code lines and announcements."""
    text = clean(doc)
    if not text or _LICENCE.search(text) and not re.search(r"(?m)^\s*@(?:param|return)", text) and _notice(text):
        return ""
    kept = []
    for line in text.split("\n"):
        m = _TAG.match(line)
        if m:
            tag, rest = m.group("tag").lower(), m.group("rest")
            if tag in _NO_TEXT:
                continue
            if tag in ("param", "throws", "exception", "property", "raises", "arg", "type"):
                rest = re.sub(r"^\s*(?:`[^`]*`|\[[^\]]*\]|[\w.]+)\s*[:\-–]?\s*", "", rest, count=1)
            line = rest
        if not line.strip() or _CODE.search(line):
            continue
        said = [s for s in re.split(r"(?<=[.!?…])\s+", line) if s.strip() and not _TO_COME.search(s)]
        if said:
            kept.append(" ".join(said))
    return "\n".join(kept).strip()


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)].rstrip("e")
    return word


def trivial(text: str, name: str | None) -> bool:
    """Whether a cleaned description tells nothing beyond the function's name."""
    if text.strip(" .!?-*_#=/\\\n\t").lower() in _NOTHING:
        return True
    known = {_stem(p) for p in _PIECE.findall(name or "")}
    compact = re.sub(r"[\W_]+", "", name or "").lower()
    new = 0
    for word in _WORD.findall(text):
        low = word.lower()
        if low in _FILLER or low == compact or all(_stem(p) in known for p in _PIECE.findall(word)):
            continue
        new += 1
    return new < 2


def _last(name: str | None, fqn_name: str | None) -> str:
    return " ".join(x for x in (name, fqn_name) if x)


def pair(source: str, doc: str | None, name: str | None, path: str | None, lang: str | None) -> tuple[str, str, str, str] | None:
    """(function name, code, description, where the documentation stood), or None if no documentation counts."""
    kind = lexer.family(path, lang, source)
    if kind not in ("brace", "python"):
        kind = "python" if re.search(r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\([^\n]*:", source) else kind if kind in ("sql", "hash") and _KEYWORD.search(source) else "brace"
    found = None
    for function in functions(source, kind):
        found = found or function
        if name and function[0].replace("_", "").lower() == name.replace("_", "").lower():
            found = function
            break
    names = _last(name, found[0] if found else None)
    said = description(doc)
    where = "doc_comment"
    if trivial(said, names):
        said = description(found[3]) if found and found[3] else ""
        where = "source"
        if trivial(said, names):
            return None
    code = source[found[1] : found[2]] if found else source
    return (found[0] if found else name or ""), code, said, where


def pairs(nodes: DataFrame) -> DataFrame:
    """(node_id, name, code, description, doc_source), one row per function node with a documentation that counts.

    Repeated rows count once; nodes of other kinds, null and blank sources give no row.
    """
    schema = pa.schema([("node_id", pa.int64()), ("name", pa.string()), ("code", pa.string()), ("description", pa.string()), ("doc_source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for node, source, doc, name, path, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if source.strip() and (made := pair(source, doc, name, path, lang)):
                    for column, value in zip(rows, (node, *made)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    wanted = nodes.where(F.col("kind").isin(*KINDS) & F.col("source_code").isNotNull() & F.col("id").isNotNull())
    return wanted.select("id", "source_code", "doc_comment", "name", "file_path", "lang").mapInArrow(run, "node_id long, name string, code string, description string, doc_source string").dropDuplicates(["node_id"])
