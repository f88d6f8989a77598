import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text) or (doc_id, text, source, lang) rows, in a few partitions."""

    def make(rows, extra=False, parts=3):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # names that the operators use themselves
            for name in ("size", "taken", "h", "sha", "body", "part", "block", "score", "name", "label", "ids", "slice"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(parts) if rows else df

    return make


@pytest.fixture(scope="session")
def repeats():
    """Texts with repeats of many kinds: null, blank, short, periodic, long, copies, near copies, ties."""
    rnd = random.Random(2)
    small, large = ["a", "b", "cc", "ddd", "é"], [str(i) for i in range(1000)]

    def words(n, voc):
        return " ".join(rnd.choice(voc) for _ in range(n))

    rows = [(i, words(rnd.randint(0, 60), small)) for i in range(50)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "x " * 300), (104, "x" * 500), (105, "x" * 500), (106, "A b c")]
    base = words(200, large)
    rows += [(200 + i, base.replace(" 7", f" {i}", 1) + " " + words(30, large)) for i in range(15)]
    rows += [(300 + i, rows[60][1]) for i in range(8)]
    rows += [(400 + i, "Only Three Words".swapcase() if i % 2 else "Only Three Words") for i in range(4)]
    return rows
