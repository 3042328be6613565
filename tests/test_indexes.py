"""The trigram index gives the rows that a look at all texts gives, and reads a share of them; indexes are kept while their files stay."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, trigrams
from tessera.sources import kept as K


@pytest.fixture(scope="module")
def paths(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé12") for _ in range(rng.randint(1, 7)))
    made = ["/".join("_".join(word() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 4))) + rng.choice([".py", ".ts", ""]) for _ in range(3000)]
    made += ["src/app/main.py", "src/app/Main_test.py", "docs/remain.md", "main.py", "__", "a-b", "src/x/get_user_by_id.ts"]
    return spark.createDataFrame([(p, "x\ny") for p in dict.fromkeys(made)], "path string, content string").cache()


@pytest.fixture(scope="module")
def index(spark, paths, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "t")
    trigrams.trigram_index(paths, "path", "path").write.partitionBy("part").parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("query", ["main.py", "src/app/main.py", "main", "get_user", "getuser", "app/ma", "ai", "é", "__", "", "zzzz", "abc_de", "remain.md", "c/d", "user by id", "1"])
def test_the_same_rows_with_and_without_the_index(paths, index, query):
    told = lambda **options: [(r.path, r.tier, r.similarity) for r in retrieval.path_search(paths, query, 40, **options).orderBy("tier", F.desc("similarity"), F.length("path"), "path").collect()]
    assert told(index=index) == told()


def test_a_query_reads_a_share_of_the_rows(spark, index):
    some = trigrams.candidates(index, "src/app/main.py")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    (parts,) = set(re.findall(r"PartitionFilters: \[.*?part#\d+ (?:IN \(|INSET )([\d, ]+)", plan))
    asked = len({*trigrams.grams_of("src/app/main.py"), *trigrams.inner_grams("src/app/main.py")})
    assert 0 < len(parts.split(",")) <= asked < trigrams.PARTS / 2
    assert re.search(r"PushedFilters: \[.*In\(gram", plan)
    assert some.count() < 0.05 * 3000
    assert trigrams.candidates(index, "ai") is None  # too short to tell


def test_inner_trigrams_are_in_every_text_that_holds_the_query():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab1_/. ") for _ in range(rng.randint(3, 20)))
        a = rng.randrange(len(text))
        query = text[a : a + rng.randint(1, 8)]
        assert set(trigrams.inner_grams(query)) <= set(trigrams.grams_of(text)), (text, query)


def test_symbols_with_and_without_the_index(spark, tmp_path):
    names = ["Main", "main", "getUser", "getUserById", "UserBox", "Box", "x", "remainder"]
    rows = [("a.py", n, f"{outer}{n}", "function", i + 1, i + 2) for i, n in enumerate(names) for outer in ("", "Outer.", "UserStore.")]
    symbols = spark.createDataFrame(rows, "path string, name string, qualified_name string, kind string, start_line int, end_line int")
    files = spark.createDataFrame([("a.py", "\n".join(f"line {i}" for i in range(20)))], "path string, content string")
    trigrams.trigram_index(symbols.select("qualified_name").distinct(), "qualified_name", "qualified_name").write.partitionBy("part").parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    for query in ("main", "User", "UserStore.Main", "store", "Outer.getUser", "x", "box", "getusr"):
        told = lambda **options: sorted(map(repr, retrieval.symbol_search(symbols, files, query, 100, **options).collect()))  # noqa: B023, E731
        assert told(index=index) == told(), query


def test_indexes_are_kept_while_their_files_stay(spark, tmp_path):
    built = []
    source = str(tmp_path / "t")

    def index():
        built.append(1)
        return spark.read.parquet(source).groupBy("a").count()

    spark.range(3).withColumnRenamed("id", "a").write.parquet(source)
    for _ in range(2):
        assert K.kept(spark, "test", source, index).count() == 3
    assert len(built) == 1
    spark.range(3, 5).withColumnRenamed("id", "a").write.mode("append").parquet(source)
    assert K.kept(spark, "test", source, index).count() == 5 and len(built) == 2
