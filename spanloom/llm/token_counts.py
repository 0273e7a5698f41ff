"""Counts of greedy word pieces by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanloom.llm.store import wider
from spanloom.llm.words import pieces

#: Marks a piece that begins a word in a SentencePiece vocabulary.
WORD_BEGIN = "▁"
#: Code points, the stride of a node's row in the transition table.
STRIDE = 0x110000


class PieceAutomaton:
    """A trie over the vocabulary with failure links, and for each link the number of pieces it pops.

    ``initial`` are pieces that begin a word, ``inner`` those that continue one. Reading a word takes one
    step for each character and each link; the pieces themselves are never built. With ``bare`` the word mark
    is a piece by itself, which stands before the inner pieces of a word that no initial piece begins.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str], bare: bool = False):
        self.step: dict[int, int] = {}
        is_piece = [False, False]  # nodes 0 and 1: before a word's first piece, and after any piece
        edges: list[list[tuple[int, int]]] = [[], []]
        for root, vocabulary in ((0, initial), (1, inner)):
            for piece in vocabulary:
                node = root
                for c in map(ord, piece):
                    at = node * STRIDE + c
                    following = self.step.get(at)
                    if following is None:
                        following = self.step[at] = len(is_piece)
                        is_piece.append(False)
                        edges.append([])
                        edges[node].append((c, following))
                    node = following
                is_piece[node] |= node > 1
        self.link = [-1] * len(is_piece)
        self.pops = [0] * len(is_piece)
        if bare:
            self.link[0], self.pops[0] = 1, 1
        waiting = deque([0, 1])
        while waiting:
            node = waiting.popleft()
            for c, child in edges[node]:
                if is_piece[child]:
                    self.link[child], self.pops[child] = 1, 1
                else:
                    to, popped = self.link[node], self.pops[node]
                    while to >= 0 and to * STRIDE + c not in self.step:
                        popped += self.pops[to]
                        to = self.link[to]
                    if to >= 0:
                        self.link[child], self.pops[child] = self.step[to * STRIDE + c], popped
                waiting.append(child)

    @classmethod
    def of(cls, step: dict[int, int], link: list[int], pops: list[int]) -> PieceAutomaton:
        """From finished tables."""
        made = cls.__new__(cls)
        made.step, made.link, made.pops = step, link, pops
        return made

    def count(self, word: str) -> int:
        """How many pieces greedy longest match cuts the word into, or -1 if it can't."""
        step, link, pops = self.step, self.link, self.pops
        node = total = 0
        for c in word:
            c = ord(c)
            following = step.get(node * STRIDE + c)
            while following is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return -1
                following = step.get(node * STRIDE + c)
            node = following
        while node > 1:
            total += pops[node]
            node = link[node]
        return total if node == 1 else -1


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """The pieces that begin a word (mark taken off) and that continue one; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(WORD_BEGIN):
            initial.append(piece[1:])
        else:
            inner.append(piece)
    return [p for p in initial if p and WORD_BEGIN not in p], [p for p in inner if WORD_BEGIN not in p]


def has_bare_mark(path: str) -> bool:
    """Whether the word mark alone is a piece of a SentencePiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return not model.is_unknown(model.piece_to_id(WORD_BEGIN))


def count_tokens(docs: DataFrame, automaton: PieceAutomaton, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_tokens`` and ``n_unknown`` to every row, from its whole text.

    Words stand between white space. A word that the vocabulary can't cover is one unknown token. Null and
    empty texts have zero of each. All columns are kept, but for those with an output name, which are
    replaced. There is no shuffle; each distinct word of a batch is read once.
    """
    names = ["n_words", "n_tokens", "n_unknown"]
    docs = docs.drop(*names)
    shipped = docs.sparkSession.sparkContext.broadcast((automaton.step, automaton.link, automaton.pops))  # as large as the vocabulary, whatever the corpus

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceAutomaton.of(*shipped.value).count
        for batch in batches:
            for part, texts in pieces(batch, text):
                words = pc.utf8_split_whitespace(texts)
                starts = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
                flat = words.values.slice(starts[0], starts[-1] - starts[0])
                starts = starts - starts[0]
                coded = pc.dictionary_encode(flat)
                distinct = coded.dictionary.to_pylist()
                each = np.fromiter((count(w) if w else 0 for w in distinct), np.int64, len(distinct))
                real = np.fromiter((w != "" for w in distinct), bool, len(distinct))
                at = coded.indices.to_numpy(zero_copy_only=False)
                sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (real.astype(np.int64), np.where(each < 0, 1, each), (each < 0).astype(np.int64))]
                arrays = [pa.array(s[starts[1:]] - s[starts[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    return docs.mapInArrow(counted, wider(docs, ", ".join(f"{n} long" for n in names)))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Word-piece counts of every whole text of ``documents``, by the public vocabulary of 32,000 pieces."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    automaton = PieceAutomaton(*sentencepiece_vocabulary(path), has_bare_mark(path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, automaton).drop("text")
