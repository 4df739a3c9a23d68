import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 30011}" for i in range(60_000))


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text) or full rows."""

    def build(*rows):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "src1", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture
def odd(documents):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing column names."""
    from pyspark.sql import functions as F

    rows = documents(
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \t\n\r ", None, "", 5),
        (None, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 3),
        (4, LONG, "de", "src2", len(LONG)),
        (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "src1", 44),
        (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "src1", 44),
        (5, "other words under the same number, with a mark # and </turn>", "fr", "src1", 44),
        (-6, "é ü \U0001f600 漢字 x y", "fr", "src0", 9),
    )
    extra = {c: F.lit("x") for c in ("size", "shard", "slot", "component", "node", "bucket", "tokens", "epoch", "domain", "first", "key",
                                   "_count", "_shift", "_total", "_rest", "_whole", "_kept", "_doc", "_own", "_order", "_bucket",
                                   "removed", "own", "aside 0", "with.dot")}
    return rows.withColumns(extra)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def labels(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")

    return build


@pytest.fixture
def benchmark_items(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "item_id bigint, text string")

    return build
