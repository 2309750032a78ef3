"""Toxicity by a convolutional network over hashed words, with thresholds calibrated by language.

A word's embedding is the sum of those of its hashed form and of its hashed character n-grams, so
inflected and unseen forms of a known stem are near it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, in_fold, text_or_empty
from .sampling import sample_per_label
from .textcnn import TextCnn

#: Buckets of hashed words and parts of words.
VOCABULARY = 1 << 15
#: Parts of words: lengths of n-grams (with an edge mark at either end).
PARTS = (4, 5)
#: Labelled documents per class that the network is fitted on; longer ones are not drawn.
PER_CLASS, MAX_CHARS = 1500, 20_000
#: Scores from here on are toxic, in every language.
CUT = 0.7
#: A language needs so many labelled documents of each class for a threshold of its own.
LEAST_PER_LANGUAGE = 15
#: Words that are scored at once, and words whose table rows a worker remembers.
BATCH_WORDS, MOST_WORDS = 1 << 17, 200_000

#: Letters of scripts without spaces between words (kana, Chinese characters, Thai, Lao, Burmese, Khmer): a word each,
#: so that filters of several widths see their neighbours too.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_features(word: str) -> np.ndarray:
    """Buckets of the word and of all its parts; the word's own comes first."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    parts = (marked[i : i + n] for n in PARTS for i in range(len(marked) - n + 1))
    return np.fromiter((zlib.crc32(x) % VOCABULARY for x in chain((marked,), parts)), np.int64)


class _Words(dict):
    """Numbers of the words met so far; ``new`` are those whose table rows are not made yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


@dataclass
class ToxicityModel:
    """A network, what tells languages apart by their words, and a raw threshold for each language."""

    net: TextCnn | None
    by_word: np.ndarray  # log probability of each bucket in each language
    thresholds: np.ndarray

    def _lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``self._table`` for each word; the table remembers a bounded number of words."""
        if not hasattr(self, "_words") or len(self._words) > MOST_WORDS:
            self._words, self._rows = _Words(), np.zeros((0, sum(self.net.widths) * self.net.filters), np.float32)
            self._votes = np.zeros((0, self.by_word.shape[1]))
        known = self._words
        ids = [np.array([known[w] for w in words], dtype=np.int64) for words in texts]
        if known.new:
            features = [word_features(w) for w in known.new]
            self._rows = np.concatenate([self._rows, self.net.ragged_table(features)])
            self._votes = np.concatenate([self._votes, self.by_word[[f[0] for f in features]]])
            known.new = []
            self._table = np.concatenate([self._rows, np.zeros((1, self._rows.shape[1]), np.float32)])
        elif not hasattr(self, "_table"):
            self._table = np.zeros((1, self._rows.shape[1]), np.float32)
        return ids

    def __getstate__(self) -> dict:
        return {"net": self.net, "by_word": self.by_word, "thresholds": self.thresholds}

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The network's probability that a whole text is toxic, and the guessed language's number."""
        raw, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        group: list[list[str]] = []
        start = size = 0
        for i, text in enumerate(texts):
            group.append(words_of(text))
            size += len(group[-1])
            if size >= BATCH_WORDS or i == len(texts) - 1:
                parts = self._lookup(group)
                ids, lengths = np.concatenate(parts), np.array([len(g) for g in group])
                raw[start : i + 1] = self.net.predict(ids, lengths, self._table)[:, 1]
                owner, votes = np.repeat(np.arange(len(group)), lengths), np.zeros((len(group), self.by_word.shape[1]))
                for k in range(self.by_word.shape[1]):
                    votes[:, k] = np.bincount(owner, weights=self._votes[ids, k], minlength=len(group))
                language[start : i + 1] = votes.argmax(axis=1)
                group, start, size = [], i + 1, 0
        return raw, language

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; ``CUT`` is where the raw probability meets the threshold of the text's language.

        The score depends on the text alone; an empty or null text gets the network's bias. Without
        labelled rows of both classes nothing is learned and every score is 0.
        """
        if self.net is None:
            return np.zeros(len(texts))
        raw, language = self.raw(texts)
        at = self.thresholds[language]
        return np.clip(np.where(raw < at, CUT * raw / at, CUT + (1 - CUT) * (raw - at) / (1 - at)), 0, 1)


def _best_threshold(raw: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between scores that gives the best F1."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + labels.sum())
    best = int(f1.argmax())
    lower = raw[order[best + 1]] if best + 1 < len(raw) else 0.0
    return float(np.clip((raw[order[best]] + lower) / 2, 0.02, 0.98))


def fit_toxicity(rows: list[Row], seed: int = 42) -> ToxicityModel:
    """Fit on rows of (text, lang, toxic), a bounded number.

    Four fifths train the network, one fifth (by turns) calibrates the thresholds. ``lang`` serves only to
    learn which words belong to which language; null counts as a language of its own.
    """
    none = ToxicityModel(None, np.zeros((VOCABULARY, 1)), np.full(1, 0.5))
    rows = [Row(text=r["text"] or "", lang=r["lang"] or "", toxic=r["toxic"]) for r in rows]
    labels = np.array([r["toxic"] for r in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return none
    known = _Words()
    ids = [np.array([known[w] for w in words_of(r["text"])], dtype=np.int64) for r in rows]
    features = [word_features(w) for w in known.new]
    own = np.array([f[0] for f in features], dtype=np.int64)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held[:] = False
    weight = np.sqrt(len(labels) / (2 * np.bincount(labels, minlength=2)))
    train = np.flatnonzero(~held)
    net = TextCnn(vocab=VOCABULARY, classes=2, dim=8, filters=8, widths=(1, 2, 3), seed=seed)
    net.weights["emb"] *= 0.3
    net.fit([ids[i] for i in train], labels[train], features, epochs=8, rate=5e-3, class_weight=weight)
    languages = sorted({r["lang"] for r in rows})
    counts = np.full((VOCABULARY, len(languages)), 0.1)
    for r, words in zip(rows, ids):
        np.add.at(counts[:, languages.index(r["lang"])], own[words], 1)
    model = ToxicityModel(net, np.log(counts / counts.sum(axis=0)), np.full(len(languages), 0.5))
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    raw, language = model.raw([rows[i]["text"] for i in check])
    overall = _best_threshold(raw, labels[check])
    for k in range(len(languages)):
        own = language == k
        enough = own.any() and np.bincount(labels[check][own], minlength=2).min() >= LEAST_PER_LANGUAGE
        model.thresholds[k] = _best_threshold(raw[own], labels[check][own]) if enough else overall
    return model


def toxicity_model(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 42) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold (crc32 of the id mod 3 is 1).

    At most ``per_class`` labels of each class are drawn from the labels alone; that bounded list goes to the
    documents, so no text is shuffled. Texts over ``MAX_CHARS`` are not fetched, nor are labels that are null or not 0 or
    1. Null texts are empty, repeated rows count once, ids with labels of both classes in both. Where either table is
    empty, or one class, nothing is learned.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~in_fold(F.col("doc_id"), 3, 1))
    drawn = sample_per_label(known.distinct(), "toxic", per_class, "doc_id", seed)
    ids = documents.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in drawn], f"id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    short = documents.select("doc_id", "text", "lang").filter(F.length(text_or_empty()) <= MAX_CHARS)
    rows = short.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "lang", "toxic")
    rows = rows.dropDuplicates(["doc_id", "toxic"]).collect()
    return fit_toxicity(sorted(rows, key=lambda r: (r["toxic"], r["doc_id"], r["text"] or "")), seed)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score as a column expression (Arrow batches); null and empty texts get the score of no words."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.score(texts.slice(at, 512).to_pylist()) for at in range(0, len(texts), 512)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and predicted, from the whole text alone.

    One row per row, equal texts alike; null and empty texts get the score of no words, a score at the cut is predicted
    1. Columns not in ``keep`` are dropped, so their names cannot clash; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            scores = model.score(batch.column("text").to_pylist())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], names=[*keep, "score", "predicted"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{types}, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document of ``documents``, learned outside the held-out fold; odd rows as in ``score_toxicity``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
