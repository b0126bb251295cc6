"""Scalar functions over texts, names and addresses, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0B\f\r]"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def normalize_query(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed; closing punctuation is cut."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _SPACE + "+", " "), "^ | $", ""), r"[?!.,;:]+$", "")


def normalize_path(url: Column) -> Column:
    """Lower-case path of an address with a leading and without a trailing slash; null where it holds a placeholder."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    cut = F.regexp_replace(F.lower(bare), "/+$", "")
    path = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    return F.when(url.isNull() | F.contains(url, F.lit("${")) | (F.trim(url) == ""), F.lit(None)).otherwise(F.when(cut == "", F.lit("/")).otherwise(path))


def normalize_fqn(fqn: Column) -> Column:
    """Old spellings of endpoints and topics in the form of synthetic nodes."""
    endpoint = F.concat(F.lit("infra:http:"), F.regexp_replace(F.regexp_replace(fqn, "^endpoint://", ""), "^([A-Z]+) +", "$1:"))
    topic = F.concat(F.lit("infra:kafka:topic:"), F.regexp_replace(fqn, "^topic://", ""))
    return F.when(fqn.startswith("endpoint://"), endpoint).when(fqn.startswith("topic://"), topic).otherwise(fqn)


def integration_type(fqn: Column) -> Column:
    """HTTP, KAFKA or CAMEL for a synthetic node, else null."""
    fqn = normalize_fqn(fqn)
    return F.when(fqn.startswith("infra:http:"), "HTTP").when(fqn.startswith("infra:kafka:"), "KAFKA").when(fqn.startswith("infra:camel:"), "CAMEL")


def integration_label(fqn: Column, name: Column) -> Column:
    """Readable label of a synthetic node, else its name."""
    norm = normalize_fqn(fqn)
    http = F.regexp_replace(F.regexp_replace(norm, "^infra:http:", ""), "^([A-Z]+):", "$1 ")
    rest = F.regexp_replace(norm, "^infra:(kafka:topic|camel:uri):", "")
    return F.when(norm.startswith("infra:http:"), http).when(norm.startswith("infra:"), rest).otherwise(F.coalesce(name, fqn))


def base_fqn(fqn: Column) -> Column:
    return F.substring_index(fqn, "(", 1)


def simple_name(name: Column) -> Column:
    """Last part of a type name without nullability mark and type arguments."""
    return F.regexp_replace(F.substring_index(F.substring_index(name, "<", 1), ".", -1), r"\?$", "")


def type_fqn(package: Column, name: Column) -> Column:
    return F.when(package.isNull() | (F.trim(package) == ""), name).otherwise(F.concat_ws(".", package, name))


def function_fqn(package: Column, owner: Column, name: Column, params: Column) -> Column:
    """owner.name(types), with the package in front where the owner lacks it."""
    head = F.when(owner.isNotNull(), F.when(F.contains(owner, F.lit(".")), owner).otherwise(type_fqn(package, owner))).otherwise(package)
    return F.concat(F.concat_ws(".", head, name), F.lit("("), F.array_join(params, ","), F.lit(")"))


# fixed values: words of signatures that are no types
SIGNATURE_WORDS = ("fun", "val", "var", "override", "public", "private", "protected", "internal", "class", "interface", "object", "where")


def types_in(text: Column) -> Column:
    """Distinct identifiers that are dotted or capitalised and no keywords."""
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), 1)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*SIGNATURE_WORDS) & (F.contains(t, F.lit(".")) | t.rlike("^[A-Z]")))))


def type_tokens(signature: Column) -> Column:
    """Types of a signature: of what stands between the first and the last bracket, and behind the last one.

    Without brackets the whole signature stands on both sides, as a text without the mark is its own part.
    """
    inner = F.regexp_replace(F.regexp_replace(signature, r"(?s)^[^(]*\(", ""), r"(?s)\)[^)]*$", "")
    return types_in(F.concat(inner, F.lit(":"), F.regexp_replace(signature, r"(?s)^.*\)", "")))


def camel_parts(name: Column) -> Column:
    """Parts before capitals and between underscores and hyphens."""
    return F.filter(F.split(F.regexp_replace(name, r"([A-Z])", "_$1"), "[_-]"), lambda p: p != "")


def has_keyword(text: Column, keyword: str) -> Column:
    """Whole word, without regard to case; very short keywords always match, blank ones never."""
    word = keyword.strip()
    if not word:
        return F.lit(False)
    if len(word) <= 2:
        return F.lit(True)
    escaped = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in word)
    return F.coalesce(text.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){escaped}($|[^\p{{L}}\p{{N}}_])"), F.lit(False))


def has_keyword_fuzzy(text: Column, keyword: str) -> Column:
    """Substring without regard to case, else all parts of the keyword longer than two characters."""
    import re

    word = keyword.strip()
    if not word:
        return F.lit(False)
    low = F.lower(text)
    parts = [p.lower() for p in re.split(r"(?=[A-Z])|[_-]", word) if len(p) > 2]
    inside = F.contains(low, F.lit(word.lower()))
    every = reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in parts]) if parts else F.lit(False)
    return F.coalesce(inside | every, F.lit(False))


def relevance(text: Column, keywords: list[str]) -> Column:
    """Sum over the keywords of 10 times the share of words that contain them or lie in them."""
    words = F.filter(F.split(F.lower(text), _SPACE + "+"), lambda w: w != "")
    total = F.size(words)

    def hit(keyword: str) -> Column:
        return F.size(F.filter(words, lambda w: F.contains(w, F.lit(keyword)) | F.contains(F.lit(keyword), w)))

    hits = [hit(k.lower()) for k in keywords if k.strip()]
    if not hits:
        return F.lit(0.0)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit(0.0)).otherwise(sum(((h * F.lit(10.0)) / total for h in hits), F.lit(0.0)))


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal; null for blank texts."""
    return F.when(F.trim(text) != "", F.sha2(text, 256))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


# fixed values: what counts as markdown
MARKDOWN = (r"(?m)^\s{0,3}#{1,6}\s", r"\[[^\]]+\]\([^)]+\)", r"`{1,3}[^`]+`{1,3}", r"(?m)^\s{0,3}[-*+]\s+", r"\*\*[^*]+\*\*|__[^_]+__")


def uses_markdown(text: Column) -> Column:
    return any_of([text.rlike(p) for p in MARKDOWN])


def grade(tokens: Column, length: Column) -> Column:
    return F.when((tokens >= 300) | (length >= 2000), "A").when((tokens >= 120) | (length >= 800), "B").otherwise("C")


def preview(text: Column, size: int = 240) -> Column:
    flat = F.regexp_replace(text, "\n", " ")
    return F.concat(F.substring(flat, 1, size), F.when(F.length(text) > size, "…").otherwise(""))


def cyrillic_ratio(text: Column) -> Column:
    """Share of Cyrillic among all letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{IsCyrillic}")) / letters).otherwise(F.lit(0.0))


def is_russian_enough(text: Column, least: float = 0.6) -> Column:
    return cyrillic_ratio(text) >= least


def normalize_code(code: Column, most: int = 10_000_000) -> Column:
    """Line ends as LF; code beyond ``most`` characters is cut and marked."""
    unix = F.regexp_replace(code, "\r\n", "\n")
    return F.when(F.length(unix) > most, F.concat(F.substring(unix, 1, most), F.lit("\n... [truncated]"))).otherwise(unix)


def line_count(code: Column) -> Column:
    return F.when(code.isNull() | (code == ""), F.lit(0)).otherwise(F.regexp_count(code, F.lit("\n")) + 1)


def env_var(value: Column) -> Column:
    name = F.regexp_extract(value, r"\$\{([^}:]+)(:([^}]*))?\}", 1)
    return F.when(F.trim(name) != "", name)


def env_default(value: Column) -> Column:
    given = F.regexp_extract(value, r"\$\{([^}:]+)(:([^}]*))?\}", 3)
    return F.when(F.trim(given) != "", given)


def resolve_default(value: Column) -> Column:
    """Placeholders replaced by their defaults; those without one stay."""
    return F.regexp_replace(value, r"\$\{[^}:]+:([^}]*[^}\s][^}]*)\}", "$1")


def looks_like_url(value: Column) -> Column:
    return F.coalesce(value.startswith("http://") | value.startswith("https://") | value.rlike(r"\$\{[^}:]+(:[^}]*)?\}"), F.lit(False))


# fixed values: parts of property groups that say nothing
GENERIC_PARTS = ("client", "settings", "config", "configuration", "properties")


def readable_infra_name(group: Column, kind: Column) -> Column:
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace(group, r"^rr\.", ""), r"^spring\.", ""), r"^spring\.cloud\.", "")
    parts = F.split(stripped, r"\.")
    telling = F.filter(parts, lambda p: ~F.lower(p).isin(*GENERIC_PARTS))
    name = F.when(F.size(parts) > 1, F.array_join(F.when(F.size(telling) > 0, telling).otherwise(parts), "-")).otherwise(stripped)
    return F.concat(name, F.lit(" ("), kind, F.lit(")"))


def section(markdown: Column, title: str) -> Column:
    """Body of the first second-level section whose heading begins with ``title``; null where there is none."""
    body = F.regexp_extract(markdown, rf"(?is)(^|\n)##[ \t]*{title}[^\n]*(.*?)(?=\n##[^#]|$(?![\r\n]))", 2)
    body = F.trim(F.regexp_replace(body, "^\n", ""))
    return F.when(body != "", body)


def unfence(answer: Column) -> Column:
    """A model's answer without the fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), "^```(json)?", ""), "```$", ""))


def first_score(answer: Column) -> Column:
    """First number of a judge's answer, held to 0..10; null without one."""
    number = F.regexp_extract(answer, r"(\d+(\.\d+)?)", 1)
    return F.when(number != "", F.least(F.greatest(number.cast("double"), F.lit(0.0)), F.lit(10.0)))


# fixed values: identifiers that a documentation need not name; the score of a documentation that cannot be read
STOP_IDENTIFIERS = ("val", "var", "fun", "return", "class", "override", "private", "public", "import", "package", "if", "else", "when", "for", "while", "try", "catch", "finally")
MIDDLE_SCORE = 5.0


def coverage(code: Column, doc: Column) -> Column:
    """10 times the share of the code's identifiers of more than three characters, each as it is written, that the documentation names in any case."""
    words = F.regexp_extract_all(code, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"), 1)
    keys = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_IDENTIFIERS)))
    low = F.lower(doc)
    named = F.size(F.filter(keys, lambda w: F.contains(low, F.lower(w))))
    blank = (F.coalesce(F.trim(code), F.lit("")) == "") | (F.coalesce(F.trim(doc), F.lit("")) == "")
    return F.when(blank, F.lit(0.0)).when(F.size(keys) == 0, F.lit(10.0)).otherwise(named * F.lit(10.0) / F.size(keys))


def readability(text: Column) -> Column:
    """Flesch reading ease, held to 0..100, in tenths; syllables are runs of vowels.  A blank text has the middle score."""
    words = F.regexp_count(text, F.lit(r"\p{L}+"))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.regexp_count(F.lower(text), F.lit("[aeiouyаеёиоуыэюяäöüáéíóúàèùâêîôû]+"))
    ease = F.lit(206.835) - F.lit(1.015) * words / sentences - F.lit(84.6) * syllables / words
    return F.when(words > 0, F.least(F.greatest(ease, F.lit(0.0)), F.lit(100.0)) / 10).otherwise(F.lit(MIDDLE_SCORE))


def final_score(cover: Column, readable: Column, semantic: Column, judge: Column) -> Column:
    """Weighted score; the mean of the three local ones where no judge answered."""
    weighted = F.lit(0.15) * semantic + F.lit(0.15) * cover + F.lit(0.10) * readable + F.lit(0.60) * judge
    return F.round(F.when(judge.isNotNull(), weighted).otherwise((cover + readable + semantic) / 3), 2)


# fixed values: names whose calls say nothing
CALL_NOISE = ("listOf", "map", "of", "timer", "start", "stop", "sequenceOf", "arrayOf", "mutableListOf")


def simple_calls(code: Column) -> Column:
    """Distinct names with a bracket behind them, whatever stands in front."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(code, F.lit(r"\b(\w+)\s*\("), 1), lambda c: ~c.isin(*CALL_NOISE))))


def dotted_calls(code: Column) -> Column:
    """Distinct calls receiver.member; neither the member nor the receiver's last part is noise."""
    noise = lambda c: c.isin(*CALL_NOISE)
    whole = F.regexp_extract_all(code, F.lit(r"([\w.]+\b\.\w+)\s*\("), 1)
    receiver = lambda c: F.substring_index(F.regexp_replace(c, r"\.\w+$", ""), ".", -1)
    return F.array_sort(F.array_distinct(F.filter(whole, lambda c: ~noise(F.substring_index(c, ".", -1)) & ~noise(receiver(c)))))


def thrown_types(code: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"throw[ \t]+(?:new[ \t]+)?([A-Z][A-Za-z0-9_.]*)"), 1)))


def strip_comment(doc: Column) -> Column:
    """A documentation comment without its marks."""
    inner = F.regexp_replace(F.regexp_replace(doc, r"^[ \t\n\r]*/\*\*?[ \t]*|[ \t\n\r]*\*/[ \t\n\r]*$", ""), r"(?m)^[ \t]*\*[ \t]?", "")
    return F.trim(F.regexp_replace(inner, "\r\n", "\n"))


def doc_summary(doc: Column) -> Column:
    """Text before the first tag, up to the first blank line."""
    body = F.regexp_replace(strip_comment(doc), r"(?s)(^|\n)[ \t]*@.*$", "")
    return F.trim(F.substring_index(body, "\n\n", 1))


def doc_params(doc: Column) -> Column:
    """name -> description of the @param tags."""
    names = F.regexp_extract_all(doc, F.lit(r"@param[ \t]+([A-Za-z0-9_]+)"), 1)
    texts = F.regexp_extract_all(doc, F.lit(r"@param[ \t]+[A-Za-z0-9_]+[ \t]*([^\r\n]*)"), 1)
    pairs = F.arrays_zip(names.alias("name"), texts.alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), F.trim(p["text"]).alias("text")))


def doc_tag(doc: Column, tag: str) -> Column:
    found = F.trim(F.regexp_extract(doc, rf"@{tag}[ \t]+([^\r\n]*)", 1))
    return F.when(found != "", found)


def annotation_argument(annotation: Column) -> Column:
    """First quoted argument of an annotation; null without one."""
    found = F.regexp_extract(annotation, r'\(\s*(?:(?:value|path)\s*=\s*)?[\[{]?\s*"([^"]*)"', 1)
    return F.when(found != "", found)


def http_verb(annotation: Column) -> Column:
    name = F.regexp_extract(annotation, r"@?(?:[\w.]+\.)?(Get|Post|Put|Delete|Patch|Request)Mapping", 1)
    given = F.regexp_extract(annotation, r"RequestMethod\.([A-Z]+)", 1)
    return F.when(name == "Request", F.when(given != "", given).otherwise("GET")).when(name != "", F.upper(name))


def backoff_seconds(attempt: int, base: float = 1.0, most: float = 30.0, jitter: float = 0.2, draw: float = 0.5) -> float:
    """Waiting time before a retry; ``draw`` in [0, 1) is the random number."""
    return min(most, base * 2 ** max(0, attempt - 1)) * (1 - jitter + 2 * jitter * draw)
