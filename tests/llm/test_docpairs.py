import pytest

from loomgraph.llm import docpairs as D

SCHEMA = "id long, kind string, name string, file_path string, lang string, source_code string, doc_comment string"
KOTLIN = '/*\n * Licence\n */\n/**\n * {doc}\n */\n@GetMapping("/a")\nfun openGate(id: Long): Int {{\n    val s = "}}"\n    // a }}\n    return 1\n}}\nfun other() = 2\n'


def test_function_with_comment_and_body():
    source = KOTLIN.format(doc="Opens the gate once every guard agrees.")
    name, code, text, where = D.pair(source, None, "openGate", "A.kt", "kotlin")
    assert (name, where) == ("openGate", "source") and text == "Opens the gate once every guard agrees."
    assert code.startswith("fun openGate") and code.endswith("return 1\n}")


def test_docstring_is_taken_from_the_body_start_only():
    source = 'def load_all(a, b={"x": 1}):\n    # first\n    """Loads every row that was left over yesterday."""\n    x = """Not a documentation at all here."""\n    return x\n\nother = 1\n'
    name, code, text, where = D.pair(source, None, "loadAll", "a.py", "other")
    assert text == "Loads every row that was left over yesterday." and where == "source" and code.rstrip().endswith("return x")
    assert D.pair('def f(a):\n    x = 1\n    """Loads every row that was left over."""\n', None, "f", "a.py", "other") is None


@pytest.mark.parametrize(
    "doc",
    [
        None, "", " \n", "/** */", "...", "-//-", "TODO", "TODO: describe what this does and when.", "FIXME", "tbd", "N/A", "none", "см. код", "{@inheritDoc}", "@author team\n@since 1.2", "@param a\n@return", "@see Other",
        "Open gate!", "Opens the gate.", "openGate()", "Open gate.\n@param id\n@return gate", "val a = b(c, 5)", "Auto-generated method stub", "<p/>", "Documentation for this function will be added later by the owning team.",
        "Комментарий создан по шаблону, описание будет добавлено владельцем метода позже.", "Copyright 2024 The Authors, all rights reserved.",
    ],
)
def test_trivial(doc):
    assert D.pair("fun openGate(id: Long): Int { return 1 }", doc, "openGate", "A.kt", "kotlin") is None


@pytest.mark.parametrize("doc", ["Drops every order older than 3 days.", "/**\r\n * Нельзя закрывать счёт, пока зеркало отстаёт.\r\n */", "Open gate.\n@return Null once the invoice has been indexed twice.", "Keeps the rows sorted by age. TODO drop Foo."])
def test_not_trivial(doc):
    assert D.pair("fun openGate(id: Long): Int { return 1 }", doc, "openGate", "A.kt", "kotlin") is not None


def test_comments_in_the_body_are_none():
    assert D.pair("fun openGate() {\n    /** Opens the gate for all of the guards. */\n    val x = 1\n}", None, "openGate", "A.kt", "kotlin") is None


def test_pairs_over_rows(spark):
    good = "Drops every order older than 3 days."
    rows = [(1, "METHOD", "a", "A.kt", "kotlin", "fun a() {}", good), (1, "METHOD", "a", "A.kt", "kotlin", "fun a() {}", good), (2, "CLASS", "b", "A.kt", "kotlin", "class b", good), (3, "METHOD", "c", None, None, None, good), (4, "JOB", None, " ", None, "  ", good), (5, "TEST", None, None, None, "x" * 200_000, good), (None, "METHOD", "a", "A.kt", "kotlin", "fun a() {}", good)]
    assert sorted(r.node_id for r in D.pairs(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 5]
    assert D.pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bodies_by_end_keyword():
    sql = "-- Adds a row.\ncreate or replace function a.f(x int) returns int as $$\nbegin\n if x then return 1; end if;\nend;\n$$ language plpgsql;\ncreate function g() returns int as $b$ select 1 $b$;\n"
    assert [(n, d) for n, _, _, d in D.functions(sql, "sql")] == [("f", "-- Adds a row."), ("g", None)]
    ruby = "# Greets.\ndef hi(n)\n  if n\n    puts 1\n  end\nend\n\ndef yo\n  while x do\n  end\nend\n"
    assert [(n, ruby[a:b].count("\n"), d) for n, a, b, d in D.functions(ruby, "hash")] == [("hi", 4, "# Greets."), ("yo", 3, None)]
    shell = "# Starts it.\nstart() {\n  if a; then b; fi\n}\nstop() {\n x\n}\n"
    assert [(n, shell[a:b].count("\n")) for n, a, b, _ in D.functions(shell, "hash")] == [("start", 2), ("stop", 2)]


def test_distance_and_size_do_not_decide():
    far = "/** Computes the yearly sum of all orders. */\n" + "@ApiResponse(code = 400)\n" * 40 + "fun total(): Int = 1\n"
    assert [d for *_, d in D.functions(far, "brace")] == ["/** Computes the yearly sum of all orders. */"]
    notice = "Copyright 2020. " + "Licensed under the terms of the licence agreement. " * 30
    assert D.description(notice) == "" and D.description("Checks whether the customer holds a driving licence. Returns false for minors. Asks the register otherwise.")


def test_time_is_in_proportion():
    import time

    for piece, kind in (("/** Computes the sum. */\nfun f(a: Int): Int {\n  return a\n}\n", "brace"), ("def f(a):\n    return a\n", "python")):
        began = time.process_time()
        assert len(list(D.functions(piece * 8000, kind))) == 8000
        assert time.process_time() - began < 3
