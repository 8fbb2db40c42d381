"""Token counts: the number of pieces of the best segmentation by a unigram vocabulary."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tillstream.llm.text import documents, per_piece

SCHEMA = "doc_id bigint, n_tokens bigint, n_unknown bigint, n_chars bigint"

#: Stands for a blank in pieces.
SPACE = "▁"
#: How much worse an unknown character scores than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Where the vocabulary is, unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts a worker keeps.
MEMORY = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; whether unknown characters fall back to their bytes, one piece for each."""

    pieces: dict[str, float]
    byte_fallback: bool = False


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file with their scores. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, fallback = {}, False
    for i in range(model.get_piece_size()):
        fallback |= model.is_byte(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    return Vocabulary(pieces, fallback)


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.fallback = vocabulary.byte_fallback
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = frozenset(piece for piece in vocabulary.pieces if len(piece) == 1)
        # Where no piece has a blank after another character, no piece spans the start of a word, and the best
        # segmentation of a text is that of its words one by one.
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        apart = not any(inner.search(piece) for piece in vocabulary.pieces)
        # Unknown characters in a row may be one piece: a blank must not be one of them.
        apart &= self.fallback or SPACE in vocabulary.pieces
        self.apart = apart
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memory = Memory(self._best)

    def _best(self, unit: str) -> tuple[int, int]:
        """Pieces and unknown characters of the best path.

        As in the tokenizer: paths are extended from each position in turn, and a later path to a place replaces an
        earlier one only if its score is larger. A character that is no piece by itself may be unknown.
        """
        if not self.single.issuperset(unit):
            return self._best_with_unknown(unit)
        # Every place is reached. The automaton gives the matches by their ends, and those of an end longest first, which
        # is the order of their starts: so all paths to a start are known when it is needed, and ties go to the first.
        score = [0.0] + [-math.inf] * len(unit)
        pieces = [0] * len(score)
        for end, (size, value) in self.automaton.iter(unit):
            start = end + 1 - size
            total = score[start] + value
            if total > score[end + 1]:
                score[end + 1] = total
                pieces[end + 1] = pieces[start] + 1
        return pieces[-1], 0

    def _best_with_unknown(self, unit: str) -> tuple[int, int]:
        n = len(unit)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(unit):
                matches[end - size + 1].append((end + 1, score))
        score: list[float | None] = [None] * (n + 1)
        pieces, unknown = [0] * (n + 1), [0] * (n + 1)
        # Whether the path ends in unknown characters: those in a row are one piece, where they have no bytes.
        open_end = [False] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            here = score[i]
            if here is None:
                continue
            single = False
            for end, value in matches[i]:
                single |= end == i + 1
                total = here + value
                if score[end] is None or total > score[end]:
                    score[end], pieces[end], unknown[end], open_end[end] = total, pieces[i] + 1, unknown[i], False
            if not single:
                total = here + self.unknown
                if score[i + 1] is None or total > score[i + 1]:
                    more = len(unit[i].encode()) if self.fallback else int(not open_end[i])
                    score[i + 1], pieces[i + 1] = total, pieces[i] + more
                    unknown[i + 1], open_end[i + 1] = unknown[i] + 1, True
        return pieces[n], unknown[n]

    def count(self, text: str) -> tuple[int, int]:
        """Pieces and unknown characters of a text. It gets a blank in front, as in the tokenizer; an empty one none."""
        if not text:
            return 0, 0
        if not self.apart:
            return self._best(SPACE + text.replace(" ", SPACE))
        if "  " in text or text[0] == " " or SPACE in text:
            units = self.units(SPACE + text.replace(" ", SPACE))
        else:
            units = (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        total = sum(map(self.memory.__getitem__, units))
        return total & Memory.LOW, total >> Memory.SHIFT


class Memory(dict):
    """Counts of words, worked out when first asked for: pieces, and above them unknown characters, in one number."""

    SHIFT = 48
    LOW = (1 << SHIFT) - 1

    def __init__(self, best: Callable[[str], tuple[int, int]]):
        super().__init__()
        self.best = best

    def __missing__(self, unit: str) -> int:
        pieces, unknown = self.best(unit)
        value = pieces | unknown << self.SHIFT
        if len(unit) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = value
        return value


#: The last vocabulary's counter, kept by a worker from task to task.
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Per document the number of pieces, of unknown characters, and of characters.

    An Aho-Corasick automaton finds every piece of the vocabulary in a word; a pass over its positions carries the best
    score and its number of pieces. The pieces themselves are never built. Words are counted once per worker as long as
    its memory of them lasts.

    One row per row. Null and empty texts have no pieces; a null id stays null; repeated rows are counted one by one,
    each text whole. An empty vocabulary makes all characters unknown. An empty table gives an empty one. Other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())  # as large as its file
    key = uuid.uuid4().hex

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = Counter(shared.value)
        texts = [text or "" for text in piece.column("text").to_pylist()]
        counts = [counter.count(text) for text in texts]
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array([pieces for pieces, _ in counts], pa.int64()),
                pa.array([unknown for _, unknown in counts], pa.int64()),
                pa.array([len(text) for text in texts], pa.int64()),
            ],
            ["doc_id", "n_tokens", "n_unknown", "n_chars"],
        )

    return per_piece(documents(docs), work, SCHEMA)
