import random

import pytest

pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tracewright.llm import token_counts as tc  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("letters", ["ab '  s\n\tlre1.é", "  \n 'rve"])
def test_edits_against_counting_anew(letters):
    counter = tc.Counter(PATH, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 800])))
        tree = tc.TokenTree(counter, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 30]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 40])))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert [p for pieces, _ in tree.blocks for p in pieces] == counter.cut(text)
            assert tree.n_tokens == len(counter.encode(text)) and tree.n_chars == len(text)


def test_only_the_edit_is_encoded_again():
    tree = tc.TokenTree(tc.Counter(PATH, public_tokenizers.PATTERN), "some words here " * 5000)
    assert tree.replace(40_000, 40_010, "another text") < 20


def test_query_and_edges(spark, edge_docs, no_docs):
    assert tc.count_with_edits(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    counter = tc.Counter(PATH, public_tokenizers.PATTERN)
    rows = tc.count_with_edits(edge_docs.orderBy("doc_id", "text").coalesce(1), PATH, public_tokenizers.PATTERN).collect()
    texts = [r.text or "" for r in edge_docs.orderBy("doc_id", "text").collect()]
    assert len(rows) == 12
    for r, text in zip(rows, texts):
        assert r.n_tokens == len(counter.encode(text))
        for a, b, new in tc.sample_edits(text):
            text = text[:a] + new + text[min(b, len(text)) :]
        assert r.n_tokens_edited == len(counter.encode(text))
