import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text) or (doc_id, text, source)."""

    def make(rows, partitions=3):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else f"s{i % 3}", len(r[1] or "")))
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


#: Columns whose names clash with ones that operators use inside.
CLASHES = ("id", "rk", "row", "key", "n", "size", "digest", "bucket", "score", "hits", "copies", "slot", "p0", "comp", "x")


@pytest.fixture
def clashing(spark):
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("?") for c in CLASHES})


def opposite_words(size=1024):
    """Two words of a and b, each the other with letters exchanged, in the order that sums of powers can't tell apart."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    return one, one.translate(str.maketrans("ab", "ba"))
