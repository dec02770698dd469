"""Operator 5: BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are inserted into a trie.  A depth-first walk gives
every trie node one state: the last token of the encoding of the node's string.
It is the one vocabulary token that ends there and stays separate from the last
token of what precedes it (two tokens are *compatible* if BPE applied to their
concatenation gives back just the two).  A prefix shared by many words is encoded
once, and the encoding of a word is read backwards from its end node.

Why this is exact: each token sequence whose neighbours are pairwise compatible is
the BPE encoding of its string, since the first merge across a token border would
also happen in the encoding of that pair alone; hence there is one such sequence.

Nulls: a null text is treated as empty.  Empty texts have no tokens.  Repeated rows
are encoded each.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm._spark import keeper, text_batches, trimmed

#: Outside of these characters the library's own normaliser and pre-tokeniser are used: inside, NFC
#: changes nothing, lower-casing works character by character, and white space is what str.split() takes.
ODD = re.compile("[^\t-\r -\u02ff\u2010-\u2027\u2030-\u205e]")


#: Token lengths to try where no token of four characters or more ends, and near the start of a word.
SHORT, STARTS = (3, 2, 1), {1: (1,), 2: (2, 1), 3: (3, 2, 1)}


class TrieBPE:
    """The encoder of one tokenizer file with word ends (``end_of_word_suffix``)."""

    #: Chunks (text between white space) kept with their encodings per Python worker; the longest one kept.
    KEEP, KEEP_CHARS = 150_000, 40
    #: Distinct words put into one trie.
    TRIE_WORDS = 20_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or spec["decoder"]:
            raise ValueError("a BPE tokenizer file with word ends and without decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split_special = re.compile(f"({names})").split if names else lambda text: [text]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.spelling = dict(enumerate(byte_characters()))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for r, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = r
            made = self.vocab[self.text_of[a] + self.text_of[b]]
            if made in self.parts or max(self.made_at(a), self.made_at(b)) >= r:
                raise ValueError("the merges are not in the order in which they make each token once")
            self.parts[made] = (r, a, b)
        self.fits: dict[int, bool] = {}
        # tokens that stand for themselves, inside a word and at its end
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in self.vocab.items():
            if self.own(i):
                if t.endswith(self.end):
                    self.final[t[: -len(self.end)]] = i
                else:
                    self.inner[t] = i
        self.inner_lengths, self.final_lengths = _lengths(self.inner), _lengths(self.final)
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = ({}, {})

    def made_at(self, token: int) -> int:
        return self.parts[token][0] if token in self.parts else -1

    def own(self, token: int) -> bool:
        """Whether BPE applied to the token's string gives the token."""
        if token not in self.parts:
            return len(self.text_of[token].removesuffix(self.end)) == 1
        _, a, b = self.parts[token]
        return self.own(a) and self.own(b) and self.compatible(a, b, self.parts[token][0])

    def compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether no merge crosses the border of a and b while they are built (up to a merge rank).

        Going back in time, the tokens at the border are the right spine of a and the left
        spine of b; a crossing merge wins if its rank is lower than that of the merge which
        really happened next (on a tie, the one further left wins).
        """
        rank, parts = self.rank, self.parts
        limit = 1 << 30 if before is None else before
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            ra, rb = self.made_at(a), self.made_at(b)
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                limit, b = rb + 1, parts[b][1]
            else:
                limit, a = ra, parts[a][2]

    def encode_words(self, words) -> dict[str, list[int]]:
        """Encodings of distinct words that are written in byte characters."""
        out = {}
        words = sorted(words)
        for at in range(0, len(words), self.TRIE_WORDS):
            self._walk(words[at : at + self.TRIE_WORDS], out)
        return out

    def _walk(self, words: list[str], out: dict[str, list[int]]) -> None:
        child: dict[tuple[int, str], int] = {}  # the trie: (node, character) -> node; 0 is the root
        token_at, length_at = [-1], [0]  # a node's state: the last token and its length
        nodes, before = [0], ""  # nodes: the path to the current word
        inner, inner_lengths = self.inner, self.inner_lengths
        fits, compatible = self.fits, self.compatible
        if len(fits) > 1_000_000:
            fits.clear()
        for word in words:  # in sorted order the nodes are made, and their states set, depth first
            size, shared = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(nodes) - 1, size - 1)
            del nodes[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                if depth == size:
                    tokens, longer = self.final, self.final_lengths
                else:
                    tokens, longer = inner, inner_lengths
                for n in longer.get(word[depth - 4 : depth], SHORT) if depth >= 4 else STARTS[depth]:
                    if n > depth:
                        continue
                    token = tokens.get(word[depth - n : depth])
                    if token is None:
                        continue
                    if n == depth:
                        break
                    last = token_at[nodes[depth - n]]
                    fit = fits.get(last << 20 | token)
                    if fit is None:
                        fit = fits[last << 20 | token] = compatible(last, token)
                    if fit:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                if depth < size:
                    node = child[nodes[-1], word[depth - 1]] = len(token_at)
                    token_at.append(token)
                    length_at.append(n)
                    nodes.append(node)
            ids, depth = [token], size - n
            while depth:
                node = nodes[depth]
                ids.append(token_at[node])
                depth -= length_at[node]
            ids.reverse()
            out[word] = ids
            before = word

    def words(self, chunk: str) -> list[str]:
        """Words of a normalised text."""
        return self.find_words(chunk)

    def chunks(self, text: str) -> list[str]:
        """Normalised texts between white space; no word crosses white space."""
        if ODD.search(text) is None:
            return text.lower().split()
        # the library's own rules, for letters whose handling depends on a Unicode version
        back = {c: i for i, c in self.spelling.items()}
        made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return ["\0" + w for w in (bytes(back[c] for c in w).decode("utf-8") for w, _ in made)]  # NUL: one word, not to be cut again

    def learn(self, chunks: set[str]) -> list[str]:
        """Puts ids (little-endian uint32) and token texts of chunks, newly encoded where unknown, into ``ids`` and ``shown``; returns the new ones that are too long to be kept."""
        if len(self.ids) > self.KEEP:  # two generations: what is used again moves to the younger one
            self.old, self.ids, self.shown = (self.ids, self.shown), {}, {}
        new = chunks - self.ids.keys()
        for c in new & self.old[0].keys():
            self.ids[c], self.shown[c] = self.old[0][c], self.old[1][c]
        new -= self.ids.keys()
        spelling, find = self.spelling, self.find_words
        spelled = {}
        for c in new:
            if c.isascii() and c[0] != "\0":
                spelled[c] = (c,) if c.isalpha() else find(c)
            else:
                spelled[c] = [w.encode("utf-8").decode("latin-1").translate(spelling) for w in ((c[1:],) if c[0] == "\0" else find(c))]
        made = self.encode_words({w for ws in spelled.values() for w in ws})
        ids, shown, text_of = self.ids, self.shown, self.text_of
        long = []
        for chunk, ws in spelled.items():
            row = made[ws[0]] if len(ws) == 1 else [i for w in ws for i in made[w]]
            if len(chunk) > self.KEEP_CHARS:
                long.append(chunk)
            ids[chunk] = struct.pack(f"<{len(row)}I", *row)
            shown[chunk] = " ".join([text_of[i] for i in row])
        return long

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of every text."""
        found = []
        for text in texts:
            pieces = []
            for part in self.split_special(text) if text and "<|" in text else (text or "",):
                if part in self.special:
                    pieces.append(part)
                else:
                    pieces.append(self.chunks(part))
            found.append(pieces)
        long = self.learn({c for pieces in found for p in pieces if isinstance(p, list) for c in p})
        ids, shown, out = self.ids, self.shown, []
        for pieces in found:
            packed = b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(ids.__getitem__, p)) for p in pieces)
            out.append((packed, " ".join(x for p in pieces for x in ([p] if isinstance(p, str) else [" ".join(map(shown.__getitem__, p))]) if x)))
        for chunk in long:
            del ids[chunk], shown[chunk]
        return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


def _lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """Lengths, longest first, that a token with the given last four characters can have."""
    found: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) >= 4:
            found.setdefault(t[-4:], set()).add(len(t))
    return {k: (*sorted(v, reverse=True), *SHORT) for k, v in found.items()}


@keeper
@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieBPE:
    return TrieBPE(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; no shuffle, memory bounded by a slice of texts.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also the
    token ids (array<int>) and the decoded text themselves.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches):
        bpe = encoder(tokenizer_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in text_batches(batches, "text"):
            rows = bpe.encode_texts(batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(p) // 4 for p, _ in rows], pa.int64()),
                pa.array([sha(p) for p, _ in rows], pa.string()),
                pa.array([sha(d.encode("utf-8")) for _, d in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                import numpy as np

                columns += [pa.array([np.frombuffer(p, "<i4") for p, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(trimmed(run, uses=encoder), schema)
