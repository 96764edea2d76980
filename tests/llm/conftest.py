import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def rows_of_documents() -> list[tuple]:
    """Copies, near copies, shared passages, junk, short, blank, null and very
    long texts; ids with ties, nulls and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 220)) for _ in range(40)]
    for i in range(6):  # copies but for white space
        texts.append(texts[i].replace(" ", "\n", i) + " " * i)
    for i in range(10):  # near copies: few words changed, some chains
        w = texts[10 + i % 4].split()
        for _ in range(1 + i // 4):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = prose(rng, 80)
    texts += [prose(rng, 70) + "\n" + shared + "\n" + prose(rng, 60) for _ in range(4)]
    texts += ["#*$ %&| " * 40 + prose(rng, 70), "again and again " * 60, "line one here\n" * 70]
    texts += ["", "   \n\t ", "one", "One  two", "é ü ß 日本語 🙂 " * 30, "x" * 70_000, prose(rng, 30_000)]
    texts += ["Released under the MIT License. " + prose(rng, 60), "cc by nc CC-BY-NC!cc by nc",
              "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n" + prose(rng, 55)]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows.append((len(rows), None, None, None, None))
    rows.append((None, texts[3], "en", "s0", 5))
    rows.append(rows[7])
    rows.append(rows[7])
    return rows


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    """The fixtures are small: two shuffle partitions while these tests run."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows_of_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clean_rows():
    """Rows with unique ids, no nulls among them."""
    seen, out = set(), []
    for r in rows_of_documents():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.fixture(scope="session")
def clean(spark, clean_rows):
    return spark.createDataFrame(clean_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
