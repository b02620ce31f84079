import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed: int, words: int) -> str:
    """Fixed words that look random."""
    out, x = [], seed * 7919 + 17
    for _ in range(words):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + WORDS[x >> 20 & 7])
    return " ".join(out)


def hard_rows() -> list[tuple]:
    """Nulls everywhere, empty, short and very long texts, copies, ties and repeated rows."""
    rows = [(i, prose(i, 60 + i), ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, 100 + i) for i in range(40)]
    rows += [(40, None, "en", "s0", None), (41, "", "en", "s0", 0), (42, " \n\t ", None, None, 4), (43, "one", "fr", "s1", 3), (44, "one two", "fr", "s1", 7)]
    rows += [(45, prose(99, 30_000), "en", "s2", 1), (46, "Größe 😀 naïve " + prose(5, 20), "de", "s3", 50)]
    rows += [(47 + i, prose(3, 63), "en", "s1", 9) for i in range(5)]
    return rows + [rows[3], rows[3], (None, prose(500, 50), "en", "s0", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def crowded(hard):
    """Extra columns with the names that operators use inside or give to results."""
    from pyspark.sql import functions as F

    names = ["_part", "_at", "_rank", "_hash", "_source", "_goal", "_below", "_id", "_body", "_gone", "size", "score", "shard", "slot", "curve",
             "target", "removed", "kept_text", "fp", "node", "held_out", "copies", "_kept", "_bad", "key", "site"]
    return hard.select("*", *[F.lit(n).alias(n) for n in names])
