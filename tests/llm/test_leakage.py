import unicodedata

from loomgraph.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, passage string"
PASSAGE = "Suppose 986 regional parcels wait in lane 241 while the voucher shows 36 and shift 151 has lost the incoming price list. Назовите первый ёлочный пакет, который покинул полку"


def test_variants(spark):
    words = PASSAGE.split()
    first13, first12 = " ".join(words[:13]), " ".join(words[:12])
    docs = {
        1: f"x {PASSAGE} y", 2: first13, 3: first12, 4: "\n".join(f"// {w.upper()}," for w in words), 5: unicodedata.normalize("NFD", PASSAGE), 6: "<b>" + PASSAGE.replace(" ", "</b> <i>") + "</i>", 7: " ".join(reversed(words)), 8: None, 9: "", 10: PASSAGE.replace("parcels", "par\u00adcels").replace(" ", "\u00a0"),
        11: " ".join(w for i, w in enumerate(words) if i != 12), 12: "w " * 60_000 + first13,
    }
    df = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], DOCS).selectExpr("*", "7 AS item_id")
    items = spark.createDataFrame([(5, PASSAGE), (6, "too short"), (7, None), (5, PASSAGE)], ITEMS)
    got = {r.doc_id: r.shared_words for r in L.leaks(df, items).collect()}
    assert set(got) == {1, 2, 4, 5, 6, 10, 11, 12} and got[2] == 13 and got[1] == len(words)
    tagged = spark.createDataFrame([(1, '<div title="' + "long attribute " * 60 + '">' + " ".join(words[:6]) + '<i class="' + "x y " * 200 + '"/> ' + " ".join(words[6:13]))], DOCS)
    assert L.leaks(tagged, items).count() == 1
    # blocks of items give the same
    assert {r.doc_id for r in L.leaks(df, items, block_bytes=1).collect()} == set(got)
    assert L.leaks(df, items.limit(0)).count() == 0 and L.leaks(df.limit(0), items).count() == 0
