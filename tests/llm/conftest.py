import pytest


@pytest.fixture
def docs(spark):
    """A documents table from texts (or (doc_id, text) pairs), with the other columns of the real one."""

    def make(items, source=None, lang="en"):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(items)]
        out = [(i, t, lang, source[k] if source else "s0", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    long = "lorem ipsum " * 40_000
    items = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text here now"), (5, "same text here now"), (6, "same text here now"), (None, "no id at all"), (7, "ünï çödé — ≠   x")]
    df = docs(items, source=[None, "a", "a", "b", "b", "b", None, "c", ""])
    names = ["hub", "band", "comp", "shard", "block", "size", "mask", "leaf", "kind", "id", "a", "b", "rep", "q", "word", "bits", "__m"]
    return df.withColumns({n: F.lit("clash") for n in names})
