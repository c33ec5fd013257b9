"""Greedy word-piece lengths in linear time, without building pieces.

The vocabulary is a trie. A state that cannot go on by the next character follows its failure link: the
state reached after the longest pieces of what was read have been popped off the front. The number of
pieces popped on the way is kept with the link, so counting needs one pass over the word's characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame

from aerolith.llm.common import map_texts

#: Words a process remembers. When there are more it starts anew; results do not change.
REMEMBERED = 250_000

_SPACE = "▁"


class LongestMatch:
    """Automaton over pieces that begin a word (``first``) and pieces that go on (``rest``).

    State 0 is the root of the first pieces, state 1 the root of the others. ``fail`` of a state is the
    state among the others that is reached by popping, or -1 if the word cannot be cut that way; ``popped``
    is how many pieces that takes.

    ``spell`` gives the number of pieces of a character that is no piece of its own. With it any word can be cut.
    """

    def __init__(self, first: set[str], rest: set[str], spell: Callable[[str], int] | None = None):
        self.spell = spell
        self.next: list[dict[str, int]] = [{}, {}]
        final = [0, 0]  # pieces that a final state stands for
        parents: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        spelled = [set(), set()] if spell is None else [{p[0] for p in first - {""}} - first, set().union(*first, *rest) - rest]
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted((pieces | spelled[root]) - {""}):
                state = root
                for c in piece:
                    if c not in self.next[state]:
                        self.next[state][c] = len(self.next)
                        self.next.append({})
                        final.append(0)
                        parents.append((state, c))
                    state = self.next[state][c]
                final[state] = spell(piece) if piece in spelled[root] else 1
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [s for root in (0, 1) for s in self.next[root].values()]
        while queue:  # by depth: a link only leads to states whose links are known
            later: list[int] = []
            for state in queue:
                parent, c = parents[state]
                if final[state]:
                    self.fail[state], self.popped[state] = 1, final[state]
                else:
                    at, n = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[state], self.popped[state] = self.next[at][c], n
                later += self.next[state].values()
            queue = later

    def length(self, word: str) -> int:
        """Number of greedy longest pieces; 1 (the unknown piece) if the word cannot be cut into pieces."""
        step, fail, popped, spell = self.next, self.fail, self.popped, self.spell
        state = n = 0
        for c in word:
            while c not in step[state]:
                if state < 2 and spell is not None:
                    n, state = n + spell(c), 1
                    break
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 1
            else:
                state = step[state][c]
        while state != 1:
            if state <= 0:
                return 1 if word else 0
            n += popped[state]
            state = fail[state]
        return n


@lru_cache(maxsize=2)
def load(model_file: str, whole: bool = False) -> LongestMatch:
    """Pieces that begin with the space mark begin a word; the others go on. Read once per process.

    ``whole``: of words with the space mark in front, all pieces go on, and a character without a piece is
    spelled by the byte pieces of its UTF-8 (by one unknown piece, if the vocabulary has no bytes).
    """
    reader = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usual = [reader.id_to_piece(i) for i in range(reader.get_piece_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
    if whole:
        spells = any(map(reader.is_byte, range(reader.get_piece_size())))
        return LongestMatch({p for p in usual if p[0] == _SPACE}, set(usual), lambda c: len(c.encode()) if spells else 1)
    return LongestMatch({p[1:] for p in usual if p[0] == _SPACE and p.strip(_SPACE)}, {p for p in usual if p[0] != _SPACE})


class Lengths(dict):
    def __init__(self, automaton: LongestMatch, mark: str = ""):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.automaton.length(self.mark + word.decode("utf-8"))
        return n


@lru_cache(maxsize=2)
def _lengths(model_file: str, whole: bool) -> Lengths:
    return Lengths(load(model_file, whole), _SPACE if whole else "")


def count_tokens(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """``keep``, n_words and n_tokens (sum of the words' greedy piece counts) of each whole text.

    Null and blank texts have 0 of both. With ``whole``, a word is cut with its space mark by the whole
    vocabulary, the lone mark and the bytes of characters without a piece included. Without it, a word that
    the other pieces do not make up counts as one token. Rows are kept one for one; an empty table gives an
    empty result.
    """

    def work():
        lengths = _lengths(model_file, whole)

        def run(texts: list[bytes]) -> dict[str, list]:
            if len(lengths) > REMEMBERED:
                lengths.clear()
            words = [t.split() for t in texts]
            return {"n_words": [len(w) for w in words], "n_tokens": [sum(map(lengths.__getitem__, w)) for w in words]}

        return run

    return map_texts(docs, "n_words long, n_tokens long", work, keep=keep)
