import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of the input they must pass through unharmed.
CLASHES = ["id", "key", "size", "bucket", "_row", "_key", "n", "k", "gram", "tkey", "start", "length", "copy", "at", "_id", "rank", "part", "block", "row", "found", "slice", "shard", "total", "node", "region"]
#: Names of what operators return, and one that holds a dot.
CLASHES += ["_shard", "_slot", "lang_pred", "score", "known", "keep_id", "kept", "component_id", "stays", "text_key", "n_tokens", "n_bytes", "over_limit", "n_words", "log_score", "taken", "target", "spans", "epochs", "shards", "sequence_id", "offset", "html", "n_shingles", "a.b"]


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, white space, nulls, empty and long texts, repeated rows and ids, one large source."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        out.append((i, " ".join(words(rng, rng.randint(1, 120))), rng.choice(["en", "fr", None]), rng.choice(["big", "big", "a", "b", None, "ç"]), i))
    base = words(rng, 200, 5000)
    for i in range(120, 150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(copy), "en", "big", 1))
    out += [(150, "Same  text\there\n", "en", "a", 1), (151, " Same text here ", "en", "a", 1), (152, "Same text here ", "en", "b", 1), (153, "same text here ", "en", "b", 1)]
    out += [(154, None, "en", "a", None), (155, "", None, None, 0), (156, " \n\t ", "en", "a", 3), (157, "...", "en", None, 3), (None, "no id at all here", "en", "a", 1), (None, None, None, None, None)]
    out += [(158, "repeated row of five words", "en", "a", 1)] * 3 + [(159, "same id other text", "en", "a", 1), (159, "same id, another text", "en", "a", 2)]
    out += [(160, " ".join(words(rng, 9000, 3000)), "en", "long", 1), (161, "é" * 3000, "fr", "long", 1), (162, "Ünïcode 漢字 <|endoftext|> <s> \x00 \U0001f642", "fr", "long", 1)]
    return out


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture
def clashing(docs):
    """The same with columns named as operators name theirs."""
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
