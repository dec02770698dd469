"""Operator 9: edit-aware token counts.

A document is cut into pre-tokens; blocks of them are the leaves of a segment tree whose
nodes hold sums of characters and tokens.  An edit is located by walking down the
character sums.  Only pre-tokens from a little before the edit are cut and encoded again,
until a new boundary meets an old one behind the edit: the pattern looks at no earlier
text, so all that follows stays as it is.  The sums above the touched leaves are updated.

Look-ahead: a pre-token can depend on two characters behind it (a contraction, or the
last blank of a run), so cutting starts at the pre-token three characters before the edit.

Nulls: a null text is empty and has no token.  Repeated rows count each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm._spark import text_batches

AHEAD = 3


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of a pre-token, with a bounded memory."""

    KEEP, KEEP_CHARS = 300_000, 48

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.cut: Callable[[str], list[str]] = self.pattern.findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.KEEP:
            known.clear()
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        new = {p: len(self.encode(p)) for p in set(pieces) if p not in known}
        found = [known[p] if p in known else new[p] for p in pieces]
        known.update((p, n) for p, n in new.items() if len(p) <= self.KEEP_CHARS)
        return found


class TokenTree:
    """The pre-tokens of one document in blocks, under a tree of sums."""

    BLOCK = 64

    def __init__(self, counter: Counter, text: str):
        self.counter = counter
        pieces = counter.cut(text)
        counts = counter.counts(pieces)
        self.blocks = [(pieces[i : i + self.BLOCK], counts[i : i + self.BLOCK]) for i in range(0, len(pieces), self.BLOCK)] or [([], [])]
        self.pieces_encoded = len(pieces)
        self._build()

    def _build(self) -> None:
        self.size = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (pieces, counts) in enumerate(self.blocks):
            self.chars[self.size + i] = len("".join(pieces))
            self.tokens[self.size + i] = sum(counts)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for pieces, _ in self.blocks for p in pieces)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, index in it, and first character of the pre-token that holds a character (the last one, behind the end)."""
        if at >= self.chars[1]:
            at = max(0, self.chars[1] - 1)
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.size
        for i, p in enumerate(self.blocks[block][0]):
            if at < start + len(p):
                return block, i, start
            start += len(p)
        return block, len(self.blocks[block][0]), start

    def _from(self, block: int, index: int) -> Iterable[tuple[int, int, str]]:
        for b in range(block, len(self.blocks)):
            pieces = self.blocks[b][0]
            for i in range(index if b == block else 0, len(pieces)):
                yield b, i, pieces[i]

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end); returns how many pre-tokens were encoded for it."""
        start = min(start, self.n_chars)
        end = max(start, min(end, self.n_chars))
        first_block, first, begin = self._find(max(0, start - AHEAD))
        old = self._from(first_block, first)
        taken: list[str] = []  # old pre-tokens from there on
        bounds: dict[int, tuple[int, int]] = {}  # old character offset behind a pre-token -> its place
        at, done, room = begin, False, 16

        def take(n: int) -> bool:
            nonlocal at
            for b, i, p in old:
                taken.append(p)
                at += len(p)
                bounds[at] = (b, i + 1)
                n -= 1
                if not n:
                    return False
            return True

        while not done and at < end:
            done = take(16)
        shift = len(new) - (end - start)
        while True:
            done = done or take(room)
            span = "".join(taken)
            text = span[: start - begin] + new + span[end - begin :]
            pieces, place, stop = [], 0, None
            for m in self.counter.pattern.finditer(text):
                if not done and m.end() + AHEAD > len(text):
                    break
                pieces.append(m.group())
                place = m.end()
                where = begin + place - shift
                if where >= end and begin + place >= start + len(new) and where in bounds:
                    stop = bounds[where]
                    break
            if stop is not None or done:
                break
            room *= 2
        if stop is None:  # cut anew up to the end of the text
            stop = (len(self.blocks) - 1, len(self.blocks[-1][0]))
        self._splice(first_block, first, *stop, pieces)
        self.pieces_encoded += len(pieces)
        return len(pieces)

    def _splice(self, block: int, first: int, last_block: int, last: int, pieces: list[str]) -> None:
        counts = self.counter.counts(pieces)
        head, tail = self.blocks[block], self.blocks[last_block]
        merged = head[0][:first] + pieces + tail[0][last:], head[1][:first] + counts + tail[1][last:]
        if block == last_block and len(merged[0]) <= 2 * self.BLOCK:
            self.blocks[block] = merged
            i = self.size + block
            self.chars[i], self.tokens[i] = len("".join(merged[0])), sum(merged[1])
            i //= 2
            while i:
                self._sum(i)
                i //= 2
            return
        n = self.BLOCK
        self.blocks[block : last_block + 1] = [(merged[0][i : i + n], merged[1][i : i + n]) for i in range(0, len(merged[0]), n)] or [([], [])]
        self._build()


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """Two edits of a text for the registered query: a passage near a third is replaced by the text's beginning, and one near three quarters is deleted."""
    n = len(text)
    size = min(200, n // 20)
    return [(n // 3, n // 3 + size, text[: size + 7]), (3 * n // 4, 3 * n // 4 + size, "")]


def count_with_edits(docs: DataFrame, tokenizer_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", edits: Callable[[str], list[tuple[int, int, str]]] = sample_edits) -> DataFrame:
    """doc_id, n_tokens, n_pieces, n_tokens_edited, n_pieces_reencoded; edits apply one after another.  Moves no data."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["n_tokens", "n_pieces", "n_tokens_edited", "n_pieces_reencoded"]

    def run(batches):
        own = counter(tokenizer_path, pattern)
        for batch in text_batches(batches, "text"):
            rows = []
            for t in batch.column(1).to_pylist():
                tree = TokenTree(own, t or "")
                before, pieces = tree.n_tokens, tree.pieces_encoded
                again = sum(tree.replace(*edit) for edit in edits(t or ""))
                rows.append((before, pieces, tree.n_tokens, again))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["doc_id", *names])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))
