"""The tables of a folder, and the content views that the retrieval and ingestion operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, snapshot_id, path, language, content)``: the documents as files of a tree."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("snapshot_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


#: The same view in SQL, for the queries' oracles.
FILES_SQL = "files AS (SELECT doc_id AS file_id, source AS snapshot_id, concat_ws('/', source, lang, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt') AS path, lang AS language, text AS content FROM documents)"


def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(review, n, pk, sk, q)``: one row for each number of an order's lines."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").alias("q"))


ONCE_SQL = "one AS (SELECT l_orderkey AS review, l_linenumber AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, path, content)``: two thirds of the documents as Python and TypeScript modules.

    The text stands in comments, the names are made from its first long word, and one module in five is broken at its end.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").where("doc_id % 3 < 2")
    i, w = F.col("doc_id").cast("string"), F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    big, low = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99), F.lit("Box")), F.concat(F.lower(w), F.lit("_"))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit(""))
    python = F.concat(F.lit("# "), F.replace(plain, F.lit("\n"), F.lit("\n# ")), F.lit("\nclass "), big, F.lit("(Base):\n    def "), low, F.lit("m(self, a=')'):\n        return a\n\ndef "), low, F.lit("f():\n    pass\n"), F.when(F.col("doc_id") % 5 == 0, "def broken(:\n").otherwise(""))
    script = F.concat(F.lit("/*"), plain, F.lit("*/\nexport class "), big, F.lit(" {\n  "), low, F.lit("m(a: string): void {\n    return `${a} {` + /[{]/.source\n  }\n}\nexport const "), low, F.lit("f = (a) => a + 1;\nconst hidden = (a) => a;\n"), F.when(F.col("doc_id") % 5 == 0, "export class Open {\n").otherwise(""))
    even = F.col("doc_id") % 3 == 0
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("mod_"), i, F.when(even, ".py").otherwise(".ts")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.when(even, python).otherwise(script).alias("content"))


#: What the modules of :func:`code` declare, in SQL.
DECLARED_SQL = """cd AS (SELECT doc_id, doc_id % 3 = 0 AS py, concat_ws('/', source, lang, 'mod_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.ts' END) AS path, regexp_extract(text, '[A-Za-z]{5,}') AS w,
  CAST(length(replace(coalesce(text, ''), '*/', '')) - length(replace(replace(coalesce(text, ''), '*/', ''), chr(10), '')) + 1 AS INT) AS n FROM documents WHERE doc_id % 3 < 2),
cn AS (SELECT *, upper(left(w, 1)) || substring(w, 2) || 'Box' AS big, lower(w) || '_' AS low FROM cd),
declared AS (SELECT path, big AS name, big AS qualified_name, 'class' AS kind, n + 1 AS start_line, CASE WHEN py THEN n + 3 ELSE n + 5 END AS end_line FROM cn
  UNION ALL SELECT path, low || 'm', big || '.' || low || 'm', 'method', n + 2, CASE WHEN py THEN n + 3 ELSE n + 4 END FROM cn
  UNION ALL SELECT path, low || 'f', low || 'f', 'function', CASE WHEN py THEN n + 5 ELSE n + 6 END, n + 6 FROM cn
  UNION ALL SELECT path, CASE WHEN py THEN 'broken' ELSE 'Open' END, CASE WHEN py THEN 'broken' ELSE 'Open' END, CASE WHEN py THEN 'function' ELSE 'class' END, CASE WHEN py THEN n + 7 ELSE n + 8 END, CASE WHEN py THEN n + 7 ELSE n + 8 END FROM cn WHERE doc_id % 5 = 0)"""
