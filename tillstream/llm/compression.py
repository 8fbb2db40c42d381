"""Quality classifier by compression with dictionaries of good and of bad text."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.calibration import class_weights, fitted, probability
from tillstream.llm.tables import class_counts, sampled_labels, sampled_texts
from tillstream.llm.text import documents, per_piece

#: Bytes of text that are compressed on their own, each time from a fresh dictionary.
SLICE_BYTES = 2048
#: Bytes of a dictionary.
DICTIONARY_BYTES = 112_640
#: Labelled documents of either class that are sampled, and slices of them that the dictionaries are built from.
SAMPLE_DOCS = 4000
SAMPLE_SLICES = 4000
#: Added to the size of a text, so that one of a few bytes tells little.
MARGIN = 8
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the calibration of their difference."""

    bad: bytes
    good: bytes
    parameters: tuple[float, float]


def _slices(text: bytes) -> list[bytes]:
    return [text[i : i + SLICE_BYTES] for i in range(0, len(text), SLICE_BYTES)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if loaded is not None:
        loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=loaded, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def difference(text: bytes, bad: bytes, good: bytes) -> float:
    """How much smaller the good dictionary makes the text than the bad one does, for each of its bytes."""
    with_bad, with_good = _compressor(bad), _compressor(good)
    a = sum(len(with_bad.compress(part)) for part in _slices(text))
    b = sum(len(with_good.compress(part)) for part in _slices(text))
    return (a - b) / (len(text) + MARGIN)


def _sample_slices(texts: DataFrame, label: int, most: int) -> list[bytes]:
    """Slices of the sampled documents of a label, those of the lowest hash."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        parts = [part for text in piece.column("text").to_pylist() for part in _slices((text or "").encode())]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    rows = per_piece(texts.filter(F.col("label") == label).select("text"), work, "part binary")
    return [row[0] for row in rows.orderBy(F.xxhash64("part"), "part").limit(most).collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_slices: int = SAMPLE_SLICES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """Dictionaries from one half of a sample of labelled documents, calibrated on the other half.

    At most ``sample_docs`` documents of either label and ``sample_slices`` slices of 2 kB of either are used. The
    calibration gives the classes the shares they have among all labels.

    Null labels and ids are left out; an id with both labels has the larger one; labels of documents that are not there count
    for the shares alone. Null and empty texts have no slices. Rows of ``docs`` that repeat an id are documents of their
    own. A class without documents has an empty dictionary; without any, and of empty tables, every score is 0.5.
    """
    chosen = sampled_labels(labels, label, sample_docs)
    # The sample of each class is in order of hash: every other one is for calibration.
    texts = sampled_texts(docs, chosen[::2])
    bad, good = (_dictionary(_sample_slices(texts, value, sample_slices), dictionary_bytes) for value in (0, 1))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        values = [difference((text or "").encode(), bad, good) for text in piece.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column("label"), pa.array(values, pa.float64())], ["label", "x"])

    held = sampled_texts(docs, chosen[1::2]).select("label", "text")
    rows = per_piece(held, work, "label int, x double").collect()
    rows = sorted((row["x"], row["label"]) for row in rows)
    x = np.array([row[0] for row in rows])
    y = np.array([row[1] for row in rows], dtype=int)
    return Model(bad, good, fitted(x, y, class_weights(y, class_counts(labels, label))))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Per document the probability that its label is 1.

    Each text is cut into slices of 2 kB, and all of them are compressed once with either dictionary; the difference of
    the sizes over the text's own size is calibrated to a score from 0 to 1.

    One row per row. Null and empty texts compress to nothing and get the score of no evidence; a null id stays null;
    repeated rows get equal scores. Without labels of one kind its dictionary is empty; without any, scores are 0.5. An
    empty table gives an empty one. Only the text is read; other columns are ignored.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        x = [difference((text or "").encode(), model.bad, model.good) for text in piece.column("text").to_pylist()]
        score = probability(np.array(x, dtype=float), model.parameters)
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return per_piece(documents(docs), work, "doc_id bigint, score double")
