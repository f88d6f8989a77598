"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Resolution of the hash that draws the sample.
_SLOTS = 1 << 30


def draw(labelled: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label (all, where there are fewer).

    Rows are drawn by a hash of ``doc_id``, so reruns agree.  Returns the rows
    and, for each label, the number of rows that one drawn row stands for.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # a row per label
    weight = {k: max(1.0, n / per_class) for k, n in counts.items()}
    slot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(_SLOTS))
    chosen = F.lit(False)
    for k, w in weight.items():
        chosen = chosen | ((F.col(label) == F.lit(k)) & (slot < F.lit(int(_SLOTS / w))))
    return labelled.where(chosen), weight


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The whole texts of the chosen ids with their labels.

    ``chosen`` holds a bounded sample of ids (see :func:`draw`), so it is
    broadcast and no text is shuffled.
    """
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
