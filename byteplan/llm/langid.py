"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_fold, text_or_empty
from .sampling import MAX_LABELS, sample_per_label
from .textcnn import TextCnn

#: Bytes in a window.
WINDOW = 128
#: Labelled documents per language that the network is fitted on, and pieces taken from each.
PER_LANGUAGE, PIECES = 400, 3
#: Bytes of text that are scored at once.
BATCH_BYTES = 1 << 19
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    languages: list[str]
    net: TextCnn | None

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = self.net.table(np.arange(257)[:, None])
        return self._table

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "net": self.net}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the mean of the windows' probabilities over the whole text.

        A text without any letter, or null, is ``und`` with score 0, as is every text where no
        language has been learned.
        """
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.net is None:
            return names, scores
        group: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                group.append((i, text.encode("utf-8", "surrogatepass")))
                size += len(group[-1][1])
            if group and (size >= BATCH_BYTES or i == len(texts) - 1):
                self._predict(group, names, scores)
                group, size = [], 0
        if group:
            self._predict(group, names, scores)
        return names, scores

    def _predict(self, group: list[tuple[int, bytes]], names: list[str], scores: np.ndarray) -> None:
        sums = np.zeros((len(group), len(self.languages)))
        weights = np.zeros(len(group))
        for first in range(0, max(len(d) for _, d in group), BATCH_BYTES):  # long texts go through in bounded parts
            parts = [d[first : first + BATCH_BYTES] for _, d in group]
            lengths, owners = [], []
            for k, part in enumerate(parts):
                whole, rest = divmod(len(part), WINDOW)
                lengths += [WINDOW] * whole + [rest] * (rest > 0)
                owners += [k] * (whole + (rest > 0))
            sizes, own = np.array(lengths), np.array(owners)
            probs = self.net.predict(np.frombuffer(b"".join(parts), np.uint8), sizes, self.table())
            np.add.at(sums, own, probs * sizes[:, None])
            np.add.at(weights, own, sizes)
        probs = sums / weights[:, None]
        for (i, _), p in zip(group, probs):
            best = int(p.argmax())
            names[i], scores[i] = self.languages[best], min(1.0, float(p[best]))


def train_language_model(labelled: DataFrame, per_language: int = PER_LANGUAGE, pieces: int = PIECES, seed: int = 42, max_languages: int = MAX_LABELS) -> LanguageModel:
    """Fit on (doc_id, text, lang): at most ``per_language`` documents of each of the ``max_languages`` most frequent languages.

    Of each the driver gets ``pieces`` pieces of a window's length at places drawn from a hash, so
    what it holds is bounded whatever the texts' lengths. Rows with a null language are not learned from, null texts
    are empty, repeated rows may be drawn more than once. Without any labelled text with a letter (an empty table,
    for one) the model knows no language and calls every text ``und``.
    """
    text = text_or_empty()
    span = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    cut = [F.substring(text, (F.pmod(F.xxhash64("doc_id", F.lit(seed + i)), span) + 1).cast("int"), WINDOW) for i in range(pieces)]
    rows = sample_per_label(labelled.select("doc_id", "lang", F.array(*cut).alias("pieces")), "lang", per_language, "doc_id", seed, max_languages)
    languages = sorted({r["lang"] for r in rows})
    found = [(p.encode("utf-8", "surrogatepass")[:WINDOW], languages.index(r["lang"])) for r in rows for p in r["pieces"] if _LETTER.search(p)]
    if not found:
        return LanguageModel(languages, None)
    net = TextCnn(vocab=256, classes=len(languages), seed=seed)
    labels = np.array([k for _, k in found])
    weight = len(labels) / (len(languages) * np.maximum(1, np.bincount(labels, minlength=len(languages))))
    net.fit([np.frombuffer(p, np.uint8) for p, _ in found], labels, np.arange(256)[:, None], epochs=4, class_weight=weight)
    return LanguageModel(languages, net)


def identify_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, from the whole text alone.

    One row per row, equal texts alike. Null texts, empty ones and those without a letter are ``und`` with score 0;
    of equally likely languages the first by name is taken. Very long texts go through in bounded parts. Columns
    not in ``keep`` are dropped, so their names cannot clash; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            names, scores = model.predict(batch.column("text").to_pylist())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{types}, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold; odd rows as in ``identify_languages``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = train_language_model(docs.filter(~held_out))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
