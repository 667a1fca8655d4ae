import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empty and long texts, copies, near copies, ties, repeated rows and clashing extra columns."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + (". " if rnd.random() < 0.08 else "") for _ in range(n)).replace("  ", " ")
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(prose(rnd.randint(5, 40)) for _ in range(rnd.randint(1, 6))), "en", f"s{i % 4}"))
    rows += [(60 + i, rows[3][1], "en", f"s{i % 3}") for i in range(12)]
    rows += [(80 + i, rows[7][1] + f" {vocabulary[i]}", "en", None) for i in range(6)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(30_000))
    rows += [(90, None, None, None), (91, "", "en", "s0"), (92, " \n\t ", "en", "s1"), (93, long, "en", "s2"), (None, "no id at all", "en", "s3"), (94, "one", "fr", "s1"), (95, "Ünï #code* 日本 ½ it's  we'll", "de", "s1")]
    rows += [rows[5], rows[5]]
    columns = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, columns)
    for c in ("fp", "score", "row", "root", "shard", "slot", "size", "label", "key", "n", "h", "pattern", "words", "before"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.repartition(5).cache()
    return docs, rows


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus[0].limit(0)
