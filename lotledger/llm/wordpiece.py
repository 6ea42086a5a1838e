"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary piece at the start of a word, then the longest
continuation at each further place; a word that can't be split is one unknown token. The vocabulary is a
trie. Each node has a failure link: where to go on when the next character has no child, after popping the
longest pieces that the node's string begins with; and the number of pieces so popped, computed beforehand.
A word's tokens are then counted in one pass over its characters, without building a piece.

Tasks count every distinct word once and keep a bounded table of counts; nothing is shuffled.

Defined results: null, empty or blank texts have no tokens; words and texts may be of any length; rows are
counted one by one, repeated or with null ids; an empty table gives no rows; further columns pass through
untouched unless they carry the name of a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MAX_WORDS = 400_000


def vocabulary(model: str) -> tuple[list[str], list[str]]:
    """Starting and continuing pieces of a SentencePiece file: those with the mark, and those without."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
    return [p[1:] for p in pieces if p[:1] == MARK and MARK not in p[1:] and p[1:]], [p for p in pieces if MARK not in p]


class Automaton:
    """Counts greedy longest-match tokens of words."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        # Node 0: before a word; node 1: between pieces. The trie of continuations hangs from node 1.
        self.children: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                        final.append(False)
                    node = nxt
                final[node] = True
        self.failure, self.popped = self._links(final)
        self.counts: dict[str, int] = {}

    def _links(self, final: list[bool]) -> tuple[list[int], list[int]]:
        """Of each node (breadth first): the node after popping, -1 if the word can't be split from here;
        and how many pieces are popped on the way."""
        failure, popped = [-1] * len(self.children), [0] * len(self.children)
        queue = [0, 1]
        for node in queue:
            for c, child in self.children[node].items():
                queue.append(child)
                if final[child]:
                    failure[child], popped[child] = 1, 1
                    continue
                link, pops = failure[node], popped[node]
                while link >= 0 and c not in self.children[link]:
                    pops += popped[link]
                    link = failure[link]
                if link >= 0:
                    failure[child], popped[child] = self.children[link][c], pops
        return failure, popped

    def count(self, word: str) -> int:
        """Tokens of a word; 0 if it can't be split."""
        children, failure, popped = self.children, self.failure, self.popped
        node = total = 0
        for c in word:
            while (nxt := children[node].get(c)) is None:
                total += popped[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = nxt
        while node != 1:  # pop what is left at the word's end
            total += popped[node]
            node = failure[node]
            if node < 0:
                return 0
        return total

    def of_texts(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """Words, tokens (an unknown word is one) and unknown words of each text."""
        if len(self.counts) > MAX_WORDS:
            self.counts = {}
        known = self.counts
        words, tokens, unknown = [], [], []
        for text in texts:
            split = (text or "").encode().split()  # bytes split at \\x20 and \\x09-\\x0D
            for w in split:
                if w not in known:
                    known[w] = self.count(w.decode())
            n = np.fromiter((known[w] for w in split), np.int64, len(split))
            words.append(len(n))
            unknown.append(int((n == 0).sum()))
            tokens.append(int(n.sum()) + unknown[-1])
        return words, tokens, unknown


def token_counts(docs: DataFrame, starts: list[str], continuations: list[str], text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown. The vocabulary is sent to the tasks once."""
    names = ["n_words", "n_tokens", "n_unknown"]
    kept = [f for f in docs.schema.fields if f.name not in names and (keep_text or f.name != text)]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType(), False) for n in names)])
    held = docs.sparkSession.sparkContext.broadcast((starts, continuations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*held.value)
        for batch in batches:
            found = automaton.of_texts(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {n: pa.array(v, pa.int64()) for n, v in zip(names, found, strict=True)})

    return docs.mapInArrow(run, schema)
