from helpers import clashing, crc, empty, odd, odd_rows, prose

from sparkcomm.llm import language


def test_held_out_accuracy_on_the_driver_table(spark):
    from sparkcomm.llm import queries

    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op3(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    table = clashing(odd(spark))
    model = language.fit(table)
    assert model.languages == ["de", "en", "fr"]
    got = language.predict(table, model).collect()
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(odd_rows(), key=lambda r: str(r[0])), strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        else:
            assert r["lang_pred"] in model.languages
    none = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.predict(table, none).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame([(i, prose(i, 120), "x") for i in range(60)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts = spark.createDataFrame([(1, prose(999, 120)), (2, "ыфв жэъ щшгн йцук " * 30), (3, "12 34")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(texts, model).collect()}
    assert not got[1]["rejected"] and got[2]["rejected"] and got[2]["lang_pred"] == "x" and got[3]["lang_pred"] == "und"


def test_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = language.fit(docs), language.fit(docs.repartition(9))
    assert a.languages == b.languages and abs(a.idf - b.idf).max() < 1e-6 and abs(a.vectors - b.vectors).max() < 1e-4
