import hashlib
import random
import tracemalloc

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tracewright.llm import word_bpe as wb  # noqa: E402
from tracewright.llm._spark import trimmed  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    out = ["", None, "<|endoftext|>hi<|startoftext|> x", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "été Ⅷ ½ İstanbul", "日本語😀 ok", "it's WE'LL can't I'D", "a\x1cb\x85c​d", "x" * 5000, "don''t '''s", "<| not special |>"]
    out += ["".join(rng.choice("abcdefgh'! 12éß") for _ in range(300)) for _ in range(100)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1F9FF)])) for _ in range(60)) for _ in range(200)]
    return out


def test_same_as_the_library(spark, monkeypatch):
    library = tokenizers.Tokenizer.from_file(PATH)
    bpe = wb.TrieBPE(PATH)
    monkeypatch.setattr(bpe, "KEEP", 40)  # generations turn over all the time
    given = texts()
    for at in range(0, len(given), 30):
        for text, (packed, shown) in zip(given[at : at + 30], bpe.encode_texts(given[at : at + 30])):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert packed == b"".join(i.to_bytes(4, "little") for i in ids)
            assert shown == library.decode(ids, skip_special_tokens=False)


def test_trie_is_plain_bpe():
    bpe = wb.TrieBPE(PATH)
    rng = random.Random(8)

    def merge(ids):
        while True:
            ranked = [(bpe.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in bpe.rank]
            if not ranked:
                return ids
            r, k = min(ranked)
            made = bpe.vocab[bpe.text_of[ids[k]] + bpe.text_of[ids[k + 1]]]
            ids = ids[:k] + [made] + ids[k + 2 :]

    words = {"".join(rng.choice("aabcdeinstr") for _ in range(rng.randint(1, 14))) for _ in range(400)}
    for word, ids in bpe.encode_words(words).items():
        assert ids == merge([bpe.vocab[c] for c in word[:-1]] + [bpe.vocab[word[-1] + bpe.end]])


def test_query_and_edges(spark, edge_docs, no_docs):
    assert wb.encode_decode(no_docs, PATH).collect() == []
    rows = wb.encode_decode(edge_docs, PATH, ids=True).collect()
    assert len(rows) == 12
    for r in rows:
        packed = b"".join(i.to_bytes(4, "little") for i in r.ids)
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(packed).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_long_chunks_are_not_kept_and_copy_nothing():
    bpe = wb.TrieBPE(PATH)
    bpe.encode_texts([" ".join(f"w{i}" for i in range(50_000))])
    kept, long = set(bpe.ids), "x" * 60
    tracemalloc.start()
    (packed, shown), again = bpe.encode_texts([long + " w1", long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = bpe.library.encode(long, add_special_tokens=False).ids
    assert again[0] == b"".join(i.to_bytes(4, "little") for i in ids) and packed.startswith(again[0]) and shown.startswith(again[1])
    assert set(bpe.ids) == set(bpe.shown) == kept and peak < 500_000  # a copy of the kept ones has megabytes


def test_tasks_of_other_operators_let_the_encoder_go():
    bpe = wb.encoder(PATH)
    assert list(trimmed(iter, uses=wb.encoder)([])) == [] and wb.encoder(PATH) is bpe
    assert list(trimmed(iter)([])) == [] and wb.encoder.cache_info().currsize == 0
