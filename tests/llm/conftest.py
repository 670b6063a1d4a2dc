import random

import pytest

WORDS = "the of and to in that is was for with".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)).capitalize() + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty, blank and very long texts, copies, ties and repeated rows."""
    rng = random.Random(7)
    out = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3)}" if rng.random() < 0.8 else "s0", 1) for i in range(120)]
    out += [(200 + i, out[i % 5][1], "en", "s1", 1) for i in range(20)]
    out += [(300 + i, out[7][1] + f" more{i}", "en", "s2", None) for i in range(10)]
    out += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, " \n\t ", "en", None, 4), (403, prose(rng, 30_000), "en", "s3", 1), (None, "a text without a key", "en", "s0", 1), (None, None, None, None, None)]
    out += [(404, "\x00 tab\tand\u00a0wide \U0001f600 é", "fr", "s0", 5), (404, "\x00 tab\tand\u00a0wide \U0001f600 é", "fr", "s0", 5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, none, tmp_path_factory):
    """Folders of tables: all documents, and none."""
    at = tmp_path_factory.mktemp("tables")
    for name, df in (("all", docs), ("none", none)):
        df.write.parquet(str(at / name / "documents.parquet"))
        pages = spark.createDataFrame([], "page_id long, url string, html string")
        pages.write.parquet(str(at / name / "pages.parquet"))
    return at
