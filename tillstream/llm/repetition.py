"""Quality rules by suffix arrays: how much of a text stands in it more than once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tillstream.llm.suffixes import Suffixes, covered
from tillstream.llm.text import PRINTED, Texts, Words, documents, per_piece, rewritten, texts_of, words_of

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, covered_words bigint, longest_repeat bigint"
)

#: Symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: Fewest words of a text, and the largest percentage of them in three-word windows that occur twice.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeats of this many words count as repeated substrings.
REPEAT_WORDS = 10
#: Largest percentage of words in such substrings, and the longest one allowed.
MAX_COVERED_PERCENT = 50
MAX_LONGEST = 100
#: Bytes of text that are worked on together: suffix arrays take many times that.
PIECE = 1 << 20

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_CODE_POINT = np.ones(256, dtype=np.int64)
_CODE_POINT[0x80:0xC0] = 0


def _sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offset])


def _repeated_lines(texts: Texts, words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    found = np.zeros(len(texts), dtype=np.int64)
    for i in np.flatnonzero(words.counts > 1):
        lines = [line for line in texts.raw(i).split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
        found[i] = len(lines) - len(set(lines))
    return found


def measured(column: pa.Array, repeat_words: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The figures of each text."""
    texts = texts_of(column)
    words = words_of(texts, PRINTED)
    n, owner = words.counts, words.text
    _, word = np.unique(words.hash, return_inverse=True)
    keys = owner * (len(words.hash) + 1) + word
    end = words.first[1:][owner]
    suffixes = Suffixes(keys, end)
    longest = suffixes.longest_repeats(3)
    at = np.flatnonzero(longest)
    windows = covered(at, at + longest[at], len(owner))
    at = np.flatnonzero(longest >= repeat_words)
    spans = covered(at, at + longest[at], len(owner))
    most = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(most, owner, np.where(longest >= repeat_words, longest, 0))
    inside = PRINTED[texts.data] * _CODE_POINT[texts.data]
    return {
        "n_words": n,
        "word_chars": _sums(inside, texts.offset),
        "n_symbols": _sums(_SYMBOL[texts.data], texts.offset),
        "n_dup_lines": _repeated_lines(texts, words),
        "n_repeat_words": _sums(windows.astype(np.int64), words.first),
        "covered_words": _sums(spans.astype(np.int64), words.first),
        "longest_repeat": most,
    }


def judged(
    figures: dict[str, np.ndarray], max_covered: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST
) -> dict[str, np.ndarray]:
    n = figures["n_words"]
    failed = (n < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (100 * figures["covered_words"] <= max_covered * n) & (figures["longest_repeat"] <= max_longest)
    return figures | {"base_failed": failed, "kept": kept}


def repetition(
    docs: DataFrame,
    repeat_words: int = REPEAT_WORDS,
    max_covered: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Per document its counts, and whether it is kept.

    A suffix array over the words of each text gives, by the longest common prefixes of neighbours, every maximal
    substring of ``repeat_words`` words or more that the text has twice. A text is kept if these cover at most
    ``max_covered`` percent of its words and none is longer than ``max_longest`` words, and if it passes the base rules.

    One row per row. Null and empty texts have no words, fail and are not kept; a null id stays null; repeated rows are
    judged one by one; texts of any length are read whole. An empty table gives an empty one. Other columns are ignored.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        figures = judged(measured(piece.column("text"), repeat_words), max_covered, max_longest)
        names = [part.split()[0] for part in SCHEMA.split(", ")][1:]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), *(pa.array(figures[name]) for name in names)], ["doc_id", *names]
        )

    return per_piece(documents(docs), work, SCHEMA, PIECE)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    Rows that repeat a document stay or go together. Null and empty texts have no words and go; null ids do not matter. An
    empty table gives an empty one.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(judged(measured(pc.cast(piece.column("text"), pa.string())))["kept"]))

    return rewritten(docs, work, PIECE)
