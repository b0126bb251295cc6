"""Sources: tables, source trees and configuration files as DataFrames.

Files are read by Spark (one row per file) and parsed in their partition; nothing passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: folders and files that hold no sources of the project
SKIP = r"/(\.git|build|out|node_modules|target|generated)/"


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of all files below ``root`` whose name fits the glob pattern."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Table scan over JDBC, split by ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


_DECLARATION = "path string, language string, package string, imports array<string>, decl_type string, name string, owner string, annotations array<string>, supertypes array<string>, signature string, line_start int, line_end int, source_code string, doc_comment string"
_TYPE = re.compile(r"(?m)^(?P<lead>(?:[ \t]*@[\w.]+(?:\([^)]*\))?[ \t]*\r?\n)*)[ \t]*(?:(?:public|private|protected|internal|abstract|final|open|sealed|data|static|inner|value|annotation|fun)[ \t]+)*(?P<what>class|interface|object|enum[ \t]+class|enum|record)[ \t]+(?P<name>\w+)(?P<rest>[^{;\n]*)")
_FUNCTION = re.compile(r"(?m)^(?P<lead>(?:[ \t]*@[\w.]+(?:\([^)]*\))?[ \t]*\r?\n)*)[ \t]*(?:(?:public|private|protected|internal|override|open|abstract|final|static|suspend|inline|operator|synchronized)[ \t]+)*(?:fun[ \t]+(?:<[^>]*>[ \t]*)?(?P<k>\w+)|(?!return\b|new\b|else\b|throw\b|class\b|interface\b|object\b|enum\b|record\b|package\b|import\b)[\w.<>\[\],?]+[ \t]+(?P<j>\w+))[ \t]*(?P<sig>\([^)]*\)[^{=;\n]*)(?=[{=])")
_FIELD = re.compile(r"(?m)^[ \t]+(?:(?:public|private|protected|internal|override|final|static|lateinit|const)[ \t]+)*(?:va[lr][ \t]+(?P<k>\w+)[ \t]*(?::[ \t]*(?P<kt>[\w.<>?, ]+))?|(?P<jt>[A-Z][\w.<>\[\]]*)[ \t]+(?P<j>\w+)[ \t]*(?==|;))")


def _close(text: str, at: int) -> int:
    """End of the block that opens at or behind ``at``; of the line where none opens."""
    stack, mask = 0, re.compile(r"\"\"\"[\s\S]*?\"\"\"|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{}]|\n")
    for m in mask.finditer(text, at):
        if m.group() == "{":
            stack += 1
        elif m.group() == "}":
            stack -= 1
            if stack <= 0:
                return m.end()
        elif m.group() == "\n" and not stack and not text[m.end() :].lstrip().startswith(("{", "=", ":")):
            return m.start()
    return len(text)


def declarations(path: str, text: str) -> list[tuple]:
    """Packages, types, functions and fields of one Kotlin or Java file, nested types under their outer ones."""
    language = "java" if path.endswith(".java") else "kotlin"
    package = (re.search(r"(?m)^[ \t]*package[ \t]+([\w.]+)", text) or [None, None])[1]
    imports = re.findall(r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)", text)
    line = lambda at: text.count("\n", 0, at) + 1
    notes = lambda lead: re.findall(r"@([\w.]+(?:\([^)]*\))?)", lead)

    def comment(at: int) -> str | None:
        m = re.search(r"(/\*\*(?:(?!\*/)[\s\S])*\*/)\s*$", text[:at])
        return m.group(1) if m else None

    out = [(path, language, package, imports, "file", path.rsplit("/", 1)[-1], None, [], [], None, 1, line(len(text)), None, None)]
    spans = []
    for m in _TYPE.finditer(text):
        end = _close(text, m.end())
        spans.append((m.start(), end, m.group("name")))
        rest = re.sub(r"\([^)]*\)", "", m.group("rest"))
        supers = re.split(r"[,\s]+", re.sub(r"^.*?(?::|\bextends\b|\bimplements\b)", "", rest, count=1).replace("implements", ",").replace("extends", ",")) if re.search(r":|\bextends\b|\bimplements\b", rest) else []
        outer = ".".join(n for a, b, n in spans[:-1] if a < m.start() < b)
        out.append((path, language, package, imports, m.group("what").split()[0], m.group("name"), outer or None, notes(m.group("lead")), [s for s in supers if s], None, line(m.start("what")), line(end), text[m.start() : end], comment(m.start())))
    owner_of = lambda at: ".".join(n for a, b, n in spans if a < at < b) or None
    bodies = []
    for m in _FUNCTION.finditer(text):
        name = m.group("k") or m.group("j")
        if any(a < m.start() < b for a, b in bodies) or name in ("if", "for", "while", "switch", "when", "catch"):
            continue
        end = _close(text, m.end())
        bodies.append((m.start(), end))
        out.append((path, language, package, imports, "function", name, owner_of(m.start()), notes(m.group("lead")), [], m.group("sig").strip(), line(m.end("lead") + 1), line(end), text[m.start() : end], comment(m.start())))
    for m in _FIELD.finditer(text):
        if owner_of(m.start()) and not any(a < m.start() < b for a, b in bodies):
            out.append((path, language, package, imports, "field", m.group("k") or m.group("j"), owner_of(m.start()), [], [], (m.group("kt") or m.group("jt") or "").strip() or None, line(m.start()), line(m.end()), m.group().strip(), None))
    return out


def scan_sources(files: DataFrame) -> DataFrame:
    """Declarations of (path, text); build output, other folders' code and files of other languages are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", _DECLARATION)]
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                yield pd.DataFrame(declarations(path, (text or "").replace("\r\n", "\n")), columns=columns)

    kept = files.where(F.col("path").rlike(r"\.(kt|java)$") & ~F.col("path").rlike(SKIP) & ~F.col("path").endswith("dependencies.kt"))
    return kept.select("path", "text").mapInPandas(run, _DECLARATION)


def plan_nodes(decls: DataFrame, application: int) -> DataFrame:
    """(application_id, fqn, name, package, kind, owner_fqn, …): rows of nodes that declarations stand for."""
    base = F.create_map(*[F.lit(x) for kv in {"class": "CLASS", "object": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "function": "METHOD", "field": "FIELD"}.items() for x in kv])
    owner = F.when(F.col("owner").isNotNull(), F.concat_ws(".", "package", "owner"))
    types = F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_extract("signature", r"\(([^)]*)\)", 1), r"<[^>]*>", ""), ","), lambda p: F.trim(F.regexp_replace(p, r"^[^:]*:\s*|\s+\w+$", ""))), ",")
    fqn = F.concat_ws(".", "package", "owner", "name")
    rows = decls.where("decl_type <> 'file'")
    return rows.select(
        F.lit(application).alias("application_id"), F.when(F.col("decl_type") == "function", F.concat(fqn, F.lit("("), types, F.lit(")"))).otherwise(fqn).alias("fqn"), "name", "package", base[F.col("decl_type")].alias("kind"),
        owner.alias("owner_fqn"), "annotations", "supertypes", "imports", "signature", "path", "line_start", "line_end", "source_code", "doc_comment",
    )


def scan_proto(files: DataFrame) -> DataFrame:
    """(path, kind, name, owner): messages, enums, services and rpcs of protocol files, by expressions alone."""
    clean = files.where(F.col("path").endswith(".proto")).select("path", F.regexp_replace(F.regexp_replace("text", r"/\*[\s\S]*?\*/", ""), r"//[^\n]*", "").alias("t"))
    top = clean.select("path", F.explode(F.regexp_extract_all("t", F.lit(r"\b((?:message|enum|service)\s+\w+)\s*\{"), 1)).alias("d"))
    types = top.select("path", F.upper(F.regexp_extract("d", r"^(\w+)", 1)).alias("kind"), F.regexp_extract("d", r"(\w+)$", 1).alias("name"), F.lit(None).cast("string").alias("owner"))
    services = clean.select("path", F.explode(F.regexp_extract_all("t", F.lit(r"(\bservice\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\})"), 1)).alias("s"))
    rpcs = services.select("path", F.lit("RPC").alias("kind"), F.explode(F.regexp_extract_all("s", F.lit(r"\brpc\s+(\w+)"), 1)).alias("name"), F.regexp_extract("s", r"service\s+(\w+)", 1).alias("owner"))
    return types.unionByName(rpcs)


def _flow(value: str) -> list[tuple[str, str]]:
    """Keys (with their dot or index) and scalars of a value in flow style; a scalar has the key ``""``."""
    value = value.strip()
    if value[:1] not in "[{" or not value or value[-1:] != {"[": "]", "{": "}"}[value[0]]:
        plain = value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value
        return [("", plain)]
    parts, depth, quote, start = [], 0, "", 1
    for i, c in enumerate(value[1:-1], 1):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(value[start:i])
            start = i + 1
    parts.append(value[start:-1])
    out = []
    for n, part in enumerate(p for p in parts if p.strip()):
        if value[0] == "[":
            out += [(f"[{n}]{k}", v) for k, v in _flow(part)]
        else:
            key, _, rest = part.partition(":")
            out += [("." + key.strip().strip("\"'") + k, v) for k, v in _flow(rest)]
    return out


def flatten_yaml(text: str) -> list[tuple[str, str]]:
    """Dotted keys of a configuration file; lists get [i]; several documents follow one another.

    A reader for what configuration files use: mappings, sequences, scalars, quotes, comments, block scalars (``|`` keeps
    lines, ``>`` folds them) and flow style.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    block: tuple[str, bool, int, list[str]] | None = None  # key, whether lines are folded, indent of the key, lines

    def close() -> None:
        if block:
            key, folded, _, lines = block
            while lines and not lines[-1].strip():
                lines.pop()
            width = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
            lines = [x[width:].rstrip() for x in lines]
            out.append((key, " ".join(lines) if folded else "\n".join(lines)))

    for raw in text.replace("\r\n", "\n").split("\n"):
        if block and (not raw.strip() or len(raw) - len(raw.lstrip()) > block[2]):
            block[3].append(raw)
            continue
        close()
        block = None
        if re.match(r"^(?:---|\.\.\.)", raw):
            stack, counts = [], {}
            continue
        body = re.sub(r"(?:^|\s)#.*$", "", raw) if not re.search(r"[\"'].*#.*[\"']", raw) else raw
        if not body.strip():
            continue
        indent = len(body) - len(body.lstrip())
        item = body.strip()
        while item == "-" or item.startswith("- "):
            while stack and stack[-1][0] >= indent and not (stack[-1][0] == indent and not stack[-1][1].startswith("[")):
                stack.pop()
            parent = ".".join(k for _, k in stack)
            n = counts.get(parent, 0)
            counts[parent] = n + 1
            stack.append((indent, f"[{n}]"))
            item = item[1:].strip()
            indent += 2
            if not item:
                break
        if not item:
            continue
        m = re.match(r"""^(?:"([^"]+)"|'([^']+)'|([^:\s][^:]*?))\s*:(?:\s+(.*))?$""", item)
        while stack and stack[-1][0] >= indent:
            stack.pop()
        path = lambda *more: ".".join([*(k for _, k in stack), *more]).replace(".[", "[")
        if not m or item[0] in "[{":
            out += [(path() + k if k.startswith("[") else (path() + k).lstrip("."), v) for k, v in _flow(item)]
            continue
        key = m.group(1) or m.group(2) or m.group(3)
        value = (m.group(4) or "").strip()
        if re.fullmatch(r"[|>][+\-0-9]*", value):
            block = (path(key), value[0] == ">", indent, [])
        elif value:
            out += [(path(key) + k, v) for k, v in _flow(value)]
        else:
            stack.append((indent, key))
    close()
    return out


def scan_yaml(files: DataFrame, by: str = "application_id") -> DataFrame:
    """(by, prop, value): flattened application* and bootstrap* files; of equal keys the last file by path wins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(owner, path, n, k, v) for owner, path, text in zip(batch[by], batch["path"], batch["text"]) for n, (k, v) in enumerate(flatten_yaml(text or ""))]
            yield pd.DataFrame(rows, columns=[by, "path", "n", "prop", "value"])

    kind = files.schema[by].dataType.simpleString()
    found = files.where(F.col("path").rlike(r"(^|/)(application|bootstrap)[^/]*\.ya?ml$")).select(by, "path", "text").mapInPandas(run, f"{by} {kind}, path string, n int, prop string, value string")
    return found.groupBy(by, "prop").agg(F.max_by("value", F.struct("path", "n")).alias("value"))


def repo_url(url: Column) -> dict[str, Column]:
    """provider, owner and name of a repository address, https or ssh."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:https?://|ssh://)?(?:[^@/]*@)?", ""), r"(\.git)?/*$", "")
    host = F.regexp_extract(bare, r"^([^/:]+)", 1)
    return {
        "provider": F.when(F.contains(host, F.lit("github")), "GITHUB").when(F.contains(host, F.lit("gitlab")), "GITLAB").when(F.contains(host, F.lit("bitbucket")), "BITBUCKET").otherwise("OTHER"),
        "owner": F.nullif(F.regexp_extract(bare, r"^[^/:]+[/:](?:\d+/)?(.+)/[^/]+$", 1), F.lit("")),
        "name": F.nullif(F.regexp_extract(bare, r"([^/:]+)$", 1), F.lit("")),
    }


def coordinate(path: Column) -> Column:
    """group:artifact:version of a library by its place in a cache of Gradle or a repository of Maven, else by its file name."""
    gradle = F.regexp_extract(path, r"files-2\.1/([^/]+)/([^/]+)/([^/]+)/[0-9a-f]+/", 1)
    g2, g3 = F.regexp_extract(path, r"files-2\.1/([^/]+)/([^/]+)/([^/]+)/[0-9a-f]+/", 2), F.regexp_extract(path, r"files-2\.1/([^/]+)/([^/]+)/([^/]+)/[0-9a-f]+/", 3)
    maven = r"\.m2/repository/(.+)/([^/]+)/([^/]+)/[^/]+\.jar$"
    m1, m2, m3 = (F.regexp_extract(path, maven, k) for k in (1, 2, 3))
    file = r"([^/]+?)-(\d[\w.\-]*)\.jar$"
    return F.when(gradle != "", F.concat_ws(":", gradle, g2, g3)).when(m1 != "", F.concat_ws(":", F.regexp_replace(m1, "/", "."), m2, m3)).when(
        F.regexp_extract(path, file, 1) != "", F.concat(F.lit("unknown:"), F.regexp_extract(path, file, 1), F.lit(":"), F.regexp_extract(path, file, 2))
    )
