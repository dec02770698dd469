import random

from tracewright.llm import langid

WORDS = {"en": "the of and water house light green stone with under morning".split(), "de": "der und nicht wasser haus licht grün stein schön über morgen".split(), "fr": "le et pas eau maison lumière vert pierre avec sous matin".split()}


def corpus(spark, n=300):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[g]) for _ in range(rng.randint(3, 40))), g) for i in range(n) for g in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    held_out = langid.fold_of(docs["doc_id"], 3) == 1
    model = langid.fit(docs.where(~held_out))
    rows = langid.predict(docs.where(held_out), model, reject=False).join(docs, "doc_id").collect()
    assert rows and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    strange = spark.createDataFrame([(1, "щы ъэ жю ячс мит"), (2, "the house of stone")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(strange, model).collect()}
    assert got[1].rejected and got[1].lang_pred == "und" and got[2].lang_pred == "en"


def test_edges(spark, edge_docs, no_docs):
    model = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(edge_docs, model).collect()} == {"und"} and langid.predict(no_docs, model).collect() == []
    model = langid.fit(edge_docs)
    rows = langid.predict(edge_docs, model, reject=False).collect()
    assert len(rows) == 12 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (1, 5)} == {"en"}


def test_fold(spark):
    import zlib

    df = spark.createDataFrame([(1,), (12345,), (None,)], "doc_id long")
    assert [r.f for r in df.select(langid.fold_of(df["doc_id"], 4).alias("f")).collect()] == [zlib.crc32(b"1") % 4, zlib.crc32(b"12345") % 4, 0]
