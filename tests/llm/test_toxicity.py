import random
import time

from pyspark.sql import functions as F

from tracewright.llm import toxicity as tx


def test_fold():
    assert tx.fold("You 1D1OT, ѕtupіd!") == " you idiot stupid "
    assert tx.fold(None) == "  " and tx.fold("s\u200bt\u00fapid") == " stupid "
    assert tx.fold("stu\u0301pid i\u0323diot") == " stupid idiot " == tx.fold("STU\u0301PID \u1ecbdiot")


def plainly(lexicon, folded):
    """Score weight by trying every entry and exception at every place."""
    at = lambda x: [i for i in range(len(folded)) if folded.startswith(x, i)]
    covers = [(i, i + len(x)) for x in lexicon.exceptions for i in at(x)]
    best = {}
    for x, w in lexicon.entries.items():
        for i in at(x):
            if not any(s <= i and i + len(x) <= e for s, e in covers):
                best[i] = max(w, best.get(i, 0))
    return sum(best.values())


def test_weight_against_brute_force():
    rng = random.Random(9)
    words = ["scum", "scummy", "pond", "trash", "trashy", "can", "idiot", "proof", "a"]
    lexicon = tx.Lexicon({" scum": 2.0, " scummy ": 3.0, " trash ": 1.5, " idiot": 2.5, " can ": 0.5}, [" pond scum ", " trash can ", " idiot proof ", " can a trash can "])
    automaton = lexicon.automaton()
    for _ in range(500):
        folded = tx.fold(" ".join(rng.choices(words, k=rng.randint(0, 12))))
        assert tx.weigh(automaton, folded) == plainly(lexicon, folded)


def test_long_text_of_phrases():
    lexicon = tx.Lexicon({" trash ": 1.5}, [" trash can "])
    text = tx.fold("trash can " * 50_000 + "trash")
    began = time.perf_counter()
    assert tx.weigh(lexicon.automaton(), text) == 1.5 and time.perf_counter() - began < 5


def test_lexicon_with_exceptions():
    lexicon = tx.Lexicon({" scum ": 3.0, " trash": 2.0}, [" trash can "])
    a = lexicon.automaton()
    assert tx.weigh(a, tx.fold("pond scum, trashy")) == 5.0
    assert tx.weigh(a, tx.fold("a trash can")) == 0.0 and tx.weigh(a, tx.fold("scummy")) == 0.0


def corpus(spark, n=900):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.25
        for _ in range(rng.randint(2, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "m0ron", "scumly", "scumish"]))
        if not bad and rng.random() < 0.05:
            w += ["idiot", "proof"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    lexicon = tx.learn(docs, labels.where("doc_id % 4 <> 2"))
    assert any("idiot proof" in e for e in lexicon.exceptions)
    rows = tx.score(docs, lexicon).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in rows) >= 0.97 * len(rows)
    kept = tx.keep_clean(docs.withColumn("score", F.lit("clash")), lexicon)
    assert kept.columns == ["doc_id", "text", "score"] and 0 < kept.count() < docs.count()


def test_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = tx.learn(edge_docs, none)
    assert lexicon.entries == {} and tx.learn(no_docs, none).entries == {}
    odd = spark.createDataFrame([(1, None), (None, 1), (6, 0), (6, 1), (99, 1)], "doc_id long, toxic int")
    lexicon = tx.learn(edge_docs, odd)
    rows = tx.score(edge_docs, lexicon).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows) and tx.score(no_docs, lexicon).collect() == []
