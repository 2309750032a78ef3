"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .url_table import labelled_urls

#: (verdict, rule): the rule is a host (it and all its subdomains) with the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Buckets of hashed n-grams and the n-grams' lengths.
BUCKETS, GRAMS = 1 << 14, (3, 4, 5)
#: URLs are blocked from this score on.
CUT = 0.5

#: Words the table holds on either side, in hosts and in paths.
_BAD = "casino poker betting jackpot porn xxx escort viagra pills spam malware phishing warez crack torrent scam clickbait linkfarm cheap replica adserver tracker".split()
_GOOD = "news blog wiki museum library weather recipes garden school history science travel music sports docs forum market city health film calendar gallery".split()


def default_table() -> list[tuple[str, bool]]:
    """The small labelled table: (url, is to be blocked)."""
    return labelled_urls()


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or where there is no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _HOST_END.split(rest, maxsplit=1)[0]
    return host.translate(_LOWER), _PATH_END.split(rest[len(host) :], maxsplit=1)[0]


_SEPARATORS = re.compile(r"[/._~%=-]+")
#: Edges of a word; in a URL itself they count as spaces.
_OPEN, _CLOSE = 2, 3
_PLAIN = str.maketrans({_OPEN: " ", _CLOSE: " "})
_STEP, _SALTS, _EITHER = np.uint32(0x01000193), (np.uint32(0x811C9DC5), np.uint32(0x2F0B4C47)), np.uint32(0x5BD1E995)


def grams_of(urls: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the distinct n-grams of the words of each (host, path); words are marked at their ends.

    Each counts once for its part and once for either part, so that a word known from hosts says something in a path too. All n-grams of all URLs are hashed together, a byte of each at a time.
    """
    edge, pieces = f"{chr(_CLOSE)}{chr(_OPEN)}", []
    for url in urls:
        for text in url:
            words = _SEPARATORS.sub(edge, text.translate(_PLAIN))
            pieces.append(f"{chr(_OPEN)}{words}{chr(_CLOSE)}".encode("utf-8", "surrogatepass"))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    part = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    places = np.arange(len(data))
    close = np.minimum.accumulate(np.where(data == _CLOSE, places, len(data))[::-1])[::-1]  # where a place's word ends
    keys = []
    for n in GRAMS:
        at = np.flatnonzero(places + n - 1 <= close)
        at = at[at + n <= len(data)]
        for salt in (np.where(part[at] % 2 == 0, *_SALTS), np.full(len(at), _EITHER)):
            h = salt
            for j in range(n):
                h = (h ^ data[at + j]) * _STEP
            h ^= h >> np.uint32(15)
            keys.append(part[at] // 2 * BUCKETS + ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(8)) % np.uint32(BUCKETS))
    keys = np.unique(np.concatenate(keys))
    return keys // BUCKETS, keys % BUCKETS


def _lengths(owner: np.ndarray, n: int) -> np.ndarray:
    """What each URL's sum of weights is divided by."""
    return np.maximum(1.0, np.sqrt(np.bincount(owner, minlength=n)))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, urls: Sequence[tuple[str, str]]) -> np.ndarray:
        """Probability that each (host, path) is to be blocked: the two alone decide."""
        if not urls:
            return np.zeros(0)
        owner, bucket = grams_of(urls)
        x = self.bias + np.bincount(owner, weights=self.weights[bucket], minlength=len(urls)) / _lengths(owner, len(urls))
        return 1 / (1 + np.exp(-x))

    def score(self, host: str, path: str) -> float:
        return float(self.scores([(host, path)])[0])


def train_url_model(table: Sequence[tuple[str, bool]] | None = None, steps: int = 1500, rate: float = 8.0, decay: float = 1e-5) -> UrlModel:
    """Gradient descent on the logistic loss over the whole (small) table; deterministic.

    An empty table blocks nothing; one with a single class learns that class's bias.
    """
    rows = default_table() if table is None else list(table)
    weights, bias = np.zeros(BUCKETS), -1.0
    if not rows:
        return UrlModel(weights, bias)
    y = np.array([float(b) for _, b in rows])
    owner, flat = grams_of([split_url(u) for u, _ in rows])
    scale = _lengths(owner, len(rows))
    for _ in range(steps):
        x = bias + np.bincount(owner, weights=weights[flat], minlength=len(rows)) / scale
        error = (1 / (1 + np.exp(-x)) - y) / len(rows)
        weights -= rate * (np.bincount(flat, weights=(error / scale)[owner], minlength=BUCKETS) + decay * weights)
        bias -= rate * 0.1 * error.sum()
    return UrlModel(weights, bias)


def match_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict; of equally long ones the first by text."""
    best, at = None, 0
    while host:
        for start, rule, verdict in rules.get(host[at:], ()):
            if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                best = rule, verdict
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return best


def rule_index(rules: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in sorted(rules, key=lambda r: (r[1], r[0] != "block")):
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url).

    Rules win over the model's score. A null URL, or one without ``://``, has an empty host and path,
    no rule, and the model's verdict on nothing (its bias). Repeated rows are judged alike; other
    columns are ignored. The rules and the model are parameters of the job and travel with its tasks;
    each row is judged on its own, so nothing is shuffled.
    """
    index = rule_index(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4096):
            urls, out = [split_url(url) for url in batch.column("url").to_pylist()], []
            for (host, path), score in zip(urls, model.scores(urls).tolist()):
                rule = match_rule(host, path, index)
                out.append((host, path, rule and rule[0], rule[1] if rule else "block" if score >= cut else "allow", score))
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, score double")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``; odd rows as in ``judge_urls``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), train_url_model())
