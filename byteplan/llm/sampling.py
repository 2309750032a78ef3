"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import unit_hash

#: Default of ``max_labels``.
MAX_LABELS = 200


def sample_per_label(rows: DataFrame, label: str, per_label: int, order: str, seed: int = 42, max_labels: int = MAX_LABELS) -> list[Row]:
    """At most ``per_label`` rows of each label, chosen by a hash of ``order`` and ``seed``.

    ``max_labels`` bounds the sample where a column holds any number of labels: of more, the most frequent are drawn,
    and a classifier fitted on the sample cannot predict the others.

    One pass counts the labels, a second keeps a fraction of each that yields 1.5 times the rows
    wanted on average; of those the driver receives at most three times the rows wanted, however
    often an id repeats. Rows with a null label are left out.
    """
    labelled = rows.filter(F.col(label).isNotNull())
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    if not counts:
        return []
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(label) == F.lit(row[0]), F.lit(min(1.0, 1.5 * per_label / row[1]))).otherwise(share)
    chosen = labelled.withColumn("draw", unit_hash(F.col(order), F.lit(seed))).filter(F.col("draw") < share)
    chosen = chosen.orderBy("draw").limit(3 * per_label * len(counts)).collect()
    out: list[Row] = []
    for row in counts:
        out += sorted((r for r in chosen if r[label] == row[0]), key=lambda r: (r["draw"], str(r)))[:per_label]
    return out
