"""Natural language hidden inside code: comments and literals, their languages and shares.

Method: every comment, string literal and documentation comment is a span, named by the 128-bit hash of its text.  Each
task hands on the text of a span only the first time it meets its hash; the texts are then deduplicated by hash and each
distinct one is classified once.  The labels are joined back to the spans by hash, which weights every file's shares.

A span is cut into lines and sentences, which may be of different languages.  Code, queries, addresses and identifiers
are taken out first.  A sentence is Russian by its script; the four Latin languages are told apart by their function words
and letters and, where these do not decide, by a model of character trigrams (naive Bayes), which is fitted on the sentences
of about ``TRAIN_ROWS`` labelled documents, chosen by hash; only trigram counts leave the executors.  A span holds a language if its sentences in it have at least ``MIN_WORDS`` words.  Null and empty texts have none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import lexer
from loomgraph.runtime import cut

MIN_WORDS = 5
TRAIN_ROWS = 4000
LATIN = ("en", "de", "es", "fr")
# the least share of known trigrams, the least lead of the best language in nats, in all and per trigram
KNOWN, LEAD, LEAD_EACH = 0.8, 6.0, 0.15
LANGUAGES = ("en", "ru", "de", "es", "fr")

# fixed values: function words, and letters that only some of the languages have
_FUNCTION = {
    "en": "the a an of and to in is are was were be been being that for it its this these those with as by on at from not no or if when while because since only never each every all any has have had will would can could may might must should after before until between without there their they he she we you which who whose into than then so but both such more most other again once under over where how what why does do did even still twice less one two".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind war waren wird werden wurde für mit von zu zum zur auf an am im in aus bei nach vor über unter als wenn weil dass damit solange sobald bevor auch noch nur kein keine keinen niemand darf kann muss soll hat haben es er sie sich man wie ohne durch gegen bis um ob aber so jede jeder jedes sehr mehr höchstens zweimal wieder".split(),
    "es": "el la los las un una unos unas y o de del al a en que es son está están fue se no con por para como más pero si cuando mientras porque aunque sin sobre entre antes después hasta desde cada todo toda su sus lo le les ya nadie nunca puede pueden debe ha han hay este esta estos estas ese esa muy dos veces solo durante mucho quedan queda otra otro".split(),
    "fr": "le la les un une des du de et ou est sont été dans que qui ne pas plus au aux en par pour sur avec sans ce cette ces il elle on se son sa ses leur leurs même si quand lorsque parce tant avant après pendant entre chaque tout tous toute mais comme dont où personne jamais peut peuvent doit a ont y deux fois encore reste avoir être".split(),
}
_WORDS = {lang: frozenset(words) for lang, words in _FUNCTION.items()}
_LETTERS = {"de": frozenset("äöüß"), "es": frozenset("ñ¿¡áíóú"), "fr": frozenset("çàâêèëîïôûùœ")}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ADDRESS = re.compile(r"[A-Za-z][\w+.\-]*://\S+|\b[\w.\-]+@[\w.\-]+\b|\bdata:\S+|(?:^|(?<=\s))[/~.]?[\w.\-]*/[\w./\-{}$]+|(?<!\w)[\w\-]+(?:\.[\w\-]+){1,}(?:\([^)]*\))?(?=[\s,;:)]|$)")
_IDENTIFIER = re.compile(r"[$@#]?\b(?:\w*[a-zа-яß-ÿ]\w*[A-ZА-Я]\w*|\w*[_\d]\w*|[A-Z]{2,}\w*)\b(?:\([^)]*\))?|\$\{[^}]*\}|%[sd]|`[^`]*`")
_TAG = re.compile(r"^\s*@\w+(?:\s+\w+(?=\s))?|</?[A-Za-z][^<>]*>|\{@\w+\s|[{}]")
_QUERY = re.compile(r"(?i)^\W*(?:select\b.+\bfrom|insert\s+into|update\s+\S+\s+set|delete\s+from|create\s+(?:or\s+replace\s+)?(?:unique\s+)?(?:table|index|view|user|role|function|sequence|schema|type|database)|alter\s+(?:table|role|user|index|column)|drop\s+(?:table|index|view|column)|merge\s+into|grant\s+\w+|with\s+\w+\s+as\s*\(|truncate|explain\s|match\s*\()")
_CODE = re.compile(r"[;{]\s*$|^\s*[}\])]|(?<![<>=!])=(?!=)|==|!=|=>|->|::|&&|\|\||\+\+|\w\(\s*\w*\s*[,)]|\w+\.\w+\(|^\s*(?:val|var|let|const|def|fun|return|import|package|public|private|protected|throw|if\s*\(|for\s*\(|while\s*\(|else|try|catch|class|elif|raise|assert|from\s+\w+\s+import)\b(?=.*[=({:;.])|^\s*[\w.\-]+\s*:\s*\S{0,40}$")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|[\r\n]+")


def language(words: list[str]) -> str | None:
    """Language of the words of one sentence."""
    cyrillic = sum(1 for w in words if "а" <= w[0] <= "я" or w[0] == "ё")
    if cyrillic * 2 > len(words):
        return "ru"
    latin = [w for w in words if w[0] < "ɐ"]
    if len(latin) * 2 <= len(words):
        return None
    score, hits = {}, {}
    for lang, known in _WORDS.items():
        parts = [p for w in latin for p in re.split(r"['’]", w)] if lang == "fr" else latin
        hits[lang] = sum(1 for w in parts if w in known)
        elided = sum(1 for w in latin if re.match(r"(?:l|d|qu|n|s|j|c|m|t|jusqu|lorsqu|puisqu)['’]", w)) if lang == "fr" else 0
        marked = sum(1 for w in latin if not _LETTERS.get(lang, frozenset()).isdisjoint(w))
        score[lang] = hits[lang] + 2 * elided + 0.8 * marked
        hits[lang] += elided + (marked > 0)
    best = max(score, key=lambda k: (score[k], k))
    return best if hits[best] >= 2 or (hits[best] and hits[best] * 5 >= len(latin)) else None


def trigrams(words: list[str]) -> list[str]:
    return [g for w in words for t in [f" {w} "] for g in (t[i : i + 3] for i in range(len(t) - 2))]


def sentences(text: str) -> Iterator[tuple[str, list[str]]]:
    """(sentence, words) of a text without code, queries, addresses and identifiers."""
    for sentence in _SENTENCE.split(text):
        if not sentence or _QUERY.match(sentence):
            continue
        bare = _ADDRESS.sub(" ", _TAG.sub(" ", sentence))
        if _CODE.search(bare):
            continue
        words = [w.lower() for w in _TOKEN.findall(_IDENTIFIER.sub(" ", bare))]
        if words:
            yield sentence, words


def guess(words: list[str], model: dict[str, tuple[float, ...]]) -> str | None:
    """Language of a sentence by its trigrams; none where too few are known or two languages lie too close."""
    grams = trigrams([w for w in words if w[0] < "ɐ"])
    known = [model[g] for g in grams if g in model]
    if len(words) < 4 or len(known) < KNOWN * len(grams):
        return None
    sums = sorted(((sum(x), lang) for x, lang in zip(zip(*known), LATIN)), reverse=True)
    lead = sums[0][0] - sums[1][0]
    return sums[0][1] if lead >= LEAD and lead >= LEAD_EACH * len(known) else None


def fit(documents: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, tuple[float, ...]]:
    """Trigram -> its log probabilities in the Latin languages, from the labelled sentences of about ``rows`` documents.

    A sentence counts if its function words agree with the document's label, since labels may be wrong and documents mixed.
    """
    labelled_ = documents.where(F.col("lang").isin(*LATIN) & F.col("text").isNotNull())
    n = labelled_.count()
    bound = int(min(1.0, rows / max(n, 1)) * ((1 << 62) - 1))
    chosen = labelled_.where(F.xxhash64("doc_id", F.lit("fit")).bitwiseAND(F.lit((1 << 62) - 1)) <= bound)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {lang: Counter() for lang in LATIN}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, words in sentences(text):
                    if language(words) == lang:
                        counts[lang].update(trigrams(words))
        rows_ = [(lang, g, k) for lang in LATIN for g, k in counts[lang].items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_), schema)] if rows_ else [pa.array([], f.type) for f in schema], schema=schema)

    found = chosen.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    table = {(r["lang"], r["gram"]): r["n"] for r in found}
    total = {lang: sum(k for (x, _), k in table.items() if x == lang) for lang in LATIN}
    grams = {g for _, g in table}
    return {g: tuple(math.log((table.get((lang, g), 0) + 0.5) / (total[lang] + 0.5 * len(grams))) for lang in LATIN) for g in grams}


def languages(text: str, model: dict[str, tuple[float, ...]] | None = None) -> dict[str, tuple[int, int]]:
    """Language -> (words, UTF-8 bytes) of the running text in one span."""
    out: dict[str, tuple[int, int]] = {}
    if _QUERY.match(text):
        return out
    for sentence, words in sentences(text):
        lang = language(words) or (guess(words, model) if model else None)
        if lang:
            n, size = out.get(lang, (0, 0))
            out[lang] = (n + len(words), size + len(sentence.encode("utf-8", "replace")))
    return out


def _worth(text: str, least: int = MIN_WORDS) -> bool:
    """Whether a span has as many words as running text needs at all."""
    return sum(1 for _ in islice(_TOKEN.finditer(text), least)) == least


def _spans(nodes: DataFrame) -> DataFrame:
    """(node_id, hash, text or null, places): spans that may hold running text; a task tells each text once."""
    schema = pa.schema([("node_id", pa.int64()), ("hash", pa.binary()), ("text", pa.string()), ("places", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for node, source, doc, path, lang in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[str, int] = {}
                if source:
                    for _, _, _, text in lexer.spans(source, lexer.family(path, lang, source)):
                        if _worth(text):
                            found[text] = found.get(text, 0) + 1
                if doc and _worth(doc):
                    text = lexer.strip_marks(doc)
                    found[text] = found.get(text, 0) + 1
                for text, n in found.items():
                    name = hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).digest()
                    new = name not in told
                    if new:
                        if len(told) >= 500_000:
                            told.clear()
                        told.add(name)
                    for column, value in zip(rows, (node, name, text if new else None, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    wanted = nodes.where("id is not null and (source_code is not null or doc_comment is not null)").select("id", "source_code", "doc_comment", "file_path", "lang")
    return wanted.mapInArrow(run, "node_id long, hash binary, text string, places int")


def _labels(texts: DataFrame, model: dict[str, tuple[float, ...]] | None) -> DataFrame:
    """(hash, text_lang, words, bytes) of each distinct text, one row per language in it."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("hash", pa.binary()), ("text_lang", pa.string()), ("words", pa.int32()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for lang, (words, size) in languages(text, shared.value).items():
                    for column, value in zip(rows, (name, lang, words, size)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return texts.mapInArrow(run, "hash binary, text_lang string, words int, bytes long")


def labelled(nodes: DataFrame, model: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(node_id, text_lang, words, bytes, places): every span's languages, one row per node, distinct text and language."""
    spans = cut(_spans(nodes))
    texts = spans.where("text is not null").select("hash", "text").dropDuplicates(["hash"])
    slim = spans.select("node_id", "hash", "places").distinct()
    return slim.join(_labels(texts, model), "hash")


def node_languages(nodes: DataFrame, min_words: int = MIN_WORDS, model: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(node_id, text_lang): the languages of which a single span of the node holds at least ``min_words`` words."""
    return labelled(nodes, model).where(F.col("words") >= min_words).select("node_id", "text_lang").distinct()


def node_shares(nodes: DataFrame, min_words: int = MIN_WORDS, model: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(node_id, text_lang, text_bytes, total_bytes, share): running text by language against source and documentation."""
    rows = labelled(nodes, model).where(F.col("words") >= min_words).groupBy("node_id", "text_lang").agg(F.sum(F.col("bytes") * F.col("places")).alias("text_bytes"))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    totals = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.max(size("source_code") + size("doc_comment")).cast("long").alias("total_bytes"))
    return rows.join(totals, "node_id").withColumn("share", F.round(F.least(F.lit(1.0), F.col("text_bytes") / F.col("total_bytes")), 6))
