import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.conftest import near_texts  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_minhash import brute as brute_near  # noqa: E402
from tests.llm.test_mixing import water  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = ["\n".join(x) for x in zip(near_texts(1, 240, 3, 40), near_texts(2, 240, 2, 50), near_texts(3, 240, 60, 60))]
    rows, labels = [], []
    for i, text in enumerate(texts):
        bad = rng.random() < 0.2
        rows.append((i, text + (" idiot you idiot moron" if bad else ""), "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, "a b", "en", None, 3)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_each_stage_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name == "toxicity":
            assert set(ids) == {i for i, _, _ in before} - toxic
        elif name == "line_dedup":
            gone = brute_lines([(i, t) for i, t, _ in before])
            text = {i: t for i, t, _ in before}
            left = {r.doc_id: r.text for r in after}
            wanted = found = 0
            for i, t in text.items():
                split = (t or "").split("\n")
                kept = [] if i not in left else (left[i] or "").split("\n")
                certain = [x for n, x in enumerate(split) if n not in gone[i]]
                rest = iter(kept)
                assert i not in left and not any(x.strip() for x in certain) or all(x in rest for x in certain)  # no line goes that should stay
                wanted += len(gone[i])
                found += len(split) - len(kept)
            print("lines that edit similarity alone removes:", wanted, "of them removed:", found)
            assert found >= 0.9 * wanted > 100
            assert all((r.text or "").strip() or not (text[r.doc_id] or "").strip() for r in after)
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "minhash":
            kept = {i for i, (_, _, keep) in brute_near([(i, t) for i, t, _ in before], 5).items() if keep}
            assert sorted(ids) == sorted(kept)
        elif name == "mixing":
            sizes, taken = {}, {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + len((t or "").split())
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
            most = max(len((t or "").split()) for _, t, _ in before)
            assert all(abs(taken.get(s, 0) - goal) <= most for s, goal in water(sizes).items())
        if name != "bpe":
            assert docs.columns == columns
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, _ in before)


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_minhash_stage_keeps_clashing_columns(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, "z")], "doc_id long, text string, _text string")
    kept = dict(pipeline.STAGES)["minhash"](spark, docs, folder)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r._text) for r in kept.collect()) == [("1", "x"), ("None", "z")]


def test_stages_shrink_the_heaps(spark, folder):
    def full_collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = full_collections()
        stage(spark, docs, folder)
        assert full_collections() > before, name
