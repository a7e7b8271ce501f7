import random
import re

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n)] if vocabulary is None else [f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n)]
    out = []
    for i in range(0, n, 12):
        out.append(" ".join(words[i:i + 12]).capitalize() + ("." if i % 36 else ".\n"))
    return " ".join(out)


def awkward_rows():
    """Documents with nulls, empty and long texts, ties, repeated rows and odd characters."""
    rows = [(i, prose(i, 30 + 7 * i), "en", f"src{i % 3}", 0) for i in range(20)]
    rows += [(100, None, "en", "src0", 0), (101, "", None, None, 0), (102, " \n\t ", "en", "src1", None), (None, prose(50, 40), "en", "src1", 1),
             (104, prose(3, 51), "en", "src2", 0), (105, prose(3, 51), "fr", None, 0), (3, prose(3, 51), "en", "src0", 0), (3, prose(3, 51), "en", "src0", 0),
             (106, prose(7, 20_000), "en", "src1", 0), (107, "Ünïcode ẞ \U0001f600   wide space <|endoftext|> \x85 x", "de", "", 0),
             (108, "menu | home | login\nAll rights reserved.", "en", "src0", 0), (109, prose(9, 60) + "\n" + prose(9, 60), "en", "src0", 0), (110, "a b", "en", "src2", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names operators use inside."""
    names = ["row", "fp", "size", "n", "key", "words", "id", "piece", "length", "start", "target", "block", "rank", "place", "train", "chunk", "hash", "mask", "label", "first", "shard", "slot"]
    return docs.withColumns({n: F.lit("x") for n in names})


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
