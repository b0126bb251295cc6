import pytest

from loomgraph.llm import lexer, prose

SCHEMA = "id long, source_code string, doc_comment string, file_path string, lang string"
TEXTS = {
    "en": "Operators see the regional timetable in the panel until it was expired.",
    "ru": "Перед записью метод блокирует ребро вызова, чтобы не потерять курсор.",
    "de": "Der Dienst verteilt den eingefrorenen Zeiger zweimal, weil der Speicher noch leer ist.",
    "es": "En cada pasada se toman como mucho 16 filas, aunque dos procesos quieren la misma clave.",
    "fr": "À chaque passage on prend au plus 366 lignes, même si l'horloge voisine avance.",
}


@pytest.mark.parametrize("lang", TEXTS)
def test_language(lang):
    assert set(prose.languages(TEXTS[lang])) == {lang}


@pytest.mark.parametrize("text", ["select a_id, b_code from t_x where m = ? and n > 5 order by z_id", "val order = legacyQuota(manifest, 4965)", "https://vault.corp.example/route/691", "anchor.shipment.sample", "Closes the survey.", "", "RUN mkdir -p /srv/bucket/digest", "路由服务在夜间重建索引"])
def test_no_text(text):
    assert not {k for k, (n, _) in prose.languages(text).items() if n >= prose.MIN_WORDS}


def test_two_languages_in_one_span():
    assert set(prose.languages(TEXTS["de"] + "\n" + TEXTS["ru"])) == {"de", "ru"}


def test_lexer():
    code = 'val a = "http://x // no" // one\n/* two\n * three */ val b = \'"\'\nval c = """four "x" """\n// say "five"\n'
    got = [(c, t.strip()) for c, _, _, t in lexer.spans(code, "brace")]
    assert ("literal", "http://x // no") in got and ("comment", "one") in got and ("comment", "two\nthree") in got and ("literal", 'four "x"') in got and ("comment", 'say "five"') in got
    assert ("literal", "Straße") in [(c, t) for c, _, _, t in lexer.spans(r'x = "Stra\u00dfe"  # c', "python")]
    assert [t for _, _, _, t in lexer.spans("insert into t values ('it''s'); -- rest", "sql")] == ["it's", "rest"]
    assert "a: text # no" not in [t for _, _, _, t in lexer.spans("k: v # yes it is\n", "hash")] and "yes it is" in [t for _, _, _, t in lexer.spans("k: v # yes it is\n", "hash")]
    assert "note" in [t.strip() for _, _, _, t in lexer.spans("<!-- note --><a b='c'/>", "xml")]


def test_rows(spark):
    escaped = 'val h = "' + "".join(f"\\u{ord(c):04x}" if ord(c) > 127 else c for c in TEXTS["ru"]) + '"'
    rows = [(1, f"// {TEXTS['en']}\n{escaped}", None, "A.kt", "kotlin"), (2, None, TEXTS["fr"], None, None), (3, f"// {TEXTS['en']}\n// {TEXTS['en']}", None, "A.kt", "kotlin"), (4, None, None, None, None), (5, "", "", "", ""), (6, "x " * 50_000, None, "a.py", "other"), (None, TEXTS["en"], None, "a.yml", "yaml")]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    assert {(r.node_id, r.text_lang) for r in prose.node_languages(df).collect()} == {(1, "en"), (1, "ru"), (2, "fr"), (3, "en")}
    shares = {(r.node_id, r.text_lang): r.share for r in prose.node_shares(df).collect()}
    assert 0.9 < shares[3, "en"] <= 1 and shares[2, "fr"] > 0.9
    assert prose.node_languages(df.limit(0)).count() == 0


def test_short_and_tabbed_spans_count():
    assert prose._worth("a\tb\tc\td\te") and not prose._worth("a b c d")
    assert prose.languages("It is. The job is on")["en"][0] == 6


def test_sentences_without_function_words(spark, data_dir):
    model = prose.fit(spark.read.parquet(f"{data_dir}/documents.parquet"))
    assert model and prose.fit(spark.read.parquet(f"{data_dir}/documents.parquet").limit(0)) == {}
    plain = {"en": "Orders arrive late every Monday morning here", "es": "usuarios nuevos registrados durante cada semana", "de": "Wir prüfen hier jeden neuen Auftrag"}
    told = {lang: set(prose.languages(text, model)) for lang, text in plain.items()}
    assert all(not got or got == {lang} for lang, got in told.items()) and sum(map(bool, told.values())) >= 1
    assert prose.guess("xqz brt plk wvd qqx".split(), model) is None
