"""Unigram vocabularies: pieces with scores, their Aho-Corasick automaton, and the best-path recursion.

The vocabulary is read from an existing SentencePiece file (never trained here); pieces
whose score marks them as unused are left out. Reference tokenizer: ``tokenizers``'
``Unigram`` over exactly these entries with byte fallback, after ``Metaspace``.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import public_tokenizers

from tagveil.llm.common import resident

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: An unknown character scores this much below the worst piece (fixed by the tokenizer).
UNKNOWN_PENALTY = 10.0
UNUSED_SCORE = -1e8
#: Words remembered by a worker; a full memory is dropped and started anew.
CACHE_WORDS, CACHED_LENGTH = 400_000, 64


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) by id. Control symbols keep their place as strings, as the reference tokenizer has them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    entries = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]
    return tuple(e for e in entries if e[1] > UNUSED_SCORE)


class Viterbi:
    """Count-only best segmentation: score and number of pieces, no piece list kept."""

    def __init__(self, model_file: str):
        entries = vocabulary(model_file)
        self.automaton = ahocorasick.Automaton()
        for piece, score in entries:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in entries)
        self.unknown = min(score for _, score in entries) - UNKNOWN_PENALTY
        self.memory: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one pre-token.

        Matches that end at a place come longest first, so the earliest start comes first,
        and a later candidate must be strictly better: the tokenizer's tie rule. A character
        without a piece of its own may be unknown; it then costs one piece per byte.
        """
        size = self.longest + 1  # a step looks back no further than the longest piece
        score, count = [0.0] * size, [0] * size
        found, unknown = self.automaton.iter(word), self.unknown
        match = next(found, None)
        for end, char in enumerate(word):
            top, pieces, single = None, 0, False
            while match is not None and match[0] == end:
                length, own = match[1]
                start = (end + 1 - length) % size
                candidate = own + score[start]
                if length == 1:
                    single = True
                if top is None or candidate > top:
                    top, pieces = candidate, count[start] + 1
                match = next(found, None)
            if not single:
                candidate = unknown + score[end % size]
                if top is None or candidate > top:
                    top, pieces = candidate, count[end % size] + len(char.encode("utf-8", "surrogatepass"))
            at = (end + 1) % size
            score[at], count[at] = top, pieces
        return count[len(word) % size], score[len(word) % size]

    def text(self, text: str) -> tuple[int, int, float]:
        """(pre-tokens, pieces, score) of a text: blanks become the space mark, each word starts at one."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if marked.startswith(SPACE):
            del words[0]
        memory, pieces, total = self.memory, 0, 0.0
        for word in words:
            got = memory.get(word)
            if got is None:
                got = self.best(SPACE + word)
                if len(word) <= CACHED_LENGTH:
                    if len(memory) >= CACHE_WORDS:
                        memory.clear()
                    memory[word] = got
            pieces += got[0]
            total += got[1]
        return len(words), pieces, total


def viterbi(model_file: str) -> Viterbi:
    """One per Python worker."""
    return resident(f"viterbi {model_file}", lambda: Viterbi(model_file))
