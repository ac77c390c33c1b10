import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns named like results."""
    long = " ".join(WORDS[i * i % 20] + str(i % 977) for i in range(40_000))
    rows = [
        (1, "one two  three", "s", 5), (2, "one two\tthree", "s", 5), (2, "one two\tthree", "s", 5), (None, "one two three", None, None),
        (3, None, "t", 1), (4, "", None, 2), (5, " \n ", "t", 3), (6, long, "t", 4), (7, long + " end", "s", 4), (8, "ein Wort: é ü", "u", 0),
        (9, long, "s", None), (None, None, None, None),
    ]
    names = ["size", "kept", "score", "shard", "spans", "rank", "line", "node", "n", "_size", "_keep", "_row", "_digest", "_bucket", "_offset", "_part", "tree", "pos", "term", "batch"]
    types = "doc_id bigint, text string, source string, " + ", ".join(f"{name} int" for name in names)
    return spark.createDataFrame([(*r, *range(1, len(names))) for r in rows], types)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
