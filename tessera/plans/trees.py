"""Queries of the tree operators. The documents are the base; the head changes them by rules on doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import trees as T
from tessera.plans.common import Registry
from tessera.plans.retrieval import lines_sql
from tessera.sources.tables import ONCE_SQL, lines_once, table

query = Registry()
SUFFIX = "\nAdded line token_name here."


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    i = F.col("doc_id")
    name = F.when(i % 10 == 0, F.concat(F.lit("build/out_"), i)).when(i % 23 == 4, F.concat(F.lit("keys/id_rsa_"), i)).otherwise(F.concat_ws("/", "source", F.concat(F.lit("f"), i, F.lit(".txt"))))
    base = docs.where(i % 19 != 5).select("doc_id", name.alias("path"), F.when(i % 41 != 0, F.sha2("text", 256)).alias("sha256"), F.col("text").alias("content"))
    moved = F.when((i % 13 == 1) | (i % 46 == 4), F.concat(F.lit("moved/"), name)).otherwise(name)
    content = F.when(i % 11 == 2, F.concat("text", F.lit(SUFFIX))).otherwise(F.col("text"))
    head = docs.where(i % 17 != 3).select("doc_id", moved.alias("path"), F.when(i % 41 != 0, F.sha2(content, 256)).alias("sha256"), content.alias("content"))
    return base, head


_name = "CASE WHEN doc_id % 10 = 0 THEN 'build/out_' || doc_id WHEN doc_id % 23 = 4 THEN 'keys/id_rsa_' || doc_id ELSE source || '/f' || doc_id || '.txt' END"
_content = "CASE WHEN doc_id % 11 = 2 THEN text || '\nAdded line token_name here.' ELSE text END"
TREES_SQL = f"""base AS (SELECT doc_id, {_name} AS path, CASE WHEN doc_id % 41 <> 0 THEN sha256(text) END AS sha256, text AS content FROM documents WHERE doc_id % 19 <> 5),
head AS (SELECT doc_id, CASE WHEN doc_id % 13 = 1 OR doc_id % 46 = 4 THEN 'moved/' ELSE '' END || {_name} AS path, CASE WHEN doc_id % 41 <> 0 THEN sha256({_content}) END AS sha256, {_content} AS content FROM documents WHERE doc_id % 17 <> 3),
changes AS (SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN b.sha256 IS DISTINCT FROM h.sha256 THEN 'modified' END AS change, b.sha256 AS base_sha256, h.sha256 AS head_sha256
  FROM base b FULL JOIN head h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR b.sha256 IS DISTINCT FROM h.sha256),
hints AS (SELECT {_name} AS old, 'moved/' || {_name} AS new FROM documents WHERE doc_id % 26 = 1),
told AS (SELECT old, min(new) AS new FROM hints WHERE new IN (SELECT path FROM changes WHERE change = 'added') AND old IN (SELECT path FROM changes WHERE change = 'removed') GROUP BY old),
o AS (SELECT path AS old, base_sha256 AS s, row_number() OVER (PARTITION BY base_sha256 ORDER BY path) AS n FROM changes WHERE change = 'removed' AND path NOT IN (SELECT old FROM told) AND base_sha256 IS NOT NULL AND base_sha256 <> sha256('')),
n AS (SELECT path AS new, head_sha256 AS s, row_number() OVER (PARTITION BY head_sha256 ORDER BY path) AS n FROM changes WHERE change = 'added' AND path NOT IN (SELECT new FROM told) AND head_sha256 IS NOT NULL AND head_sha256 <> sha256('')),
pairs AS (SELECT old, new FROM told UNION ALL SELECT old, new FROM o JOIN n ON o.s = n.s AND o.n = n.n)"""
_credential = lambda c: f"regexp_matches(string_split({c}, '/')[-1], '^id_rsa')"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    i = F.col("doc_id")
    name = F.when(i % 10 == 0, F.concat(F.lit("build/out_"), i)).when(i % 23 == 4, F.concat(F.lit("keys/id_rsa_"), i)).otherwise(F.concat_ws("/", "source", F.concat(F.lit("f"), i, F.lit(".txt"))))
    return docs.where(i % 26 == 1).select(name.alias("old"), F.concat(F.lit("moved/"), name).alias("new"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.compare_trees(*both(spark, sf_dir))


@query(f"WITH {TREES_SQL} SELECT path, change FROM changes")
def compare_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("path", "change")


@query(f"WITH {TREES_SQL} SELECT * FROM pairs")
def pair_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pair_renames(changes(spark, sf_dir), hints(spark, sf_dir))


@query(f"""WITH {TREES_SQL} SELECT path FROM changes WHERE {_credential("path")} UNION SELECT old FROM pairs WHERE {_credential("old")} OR {_credential("new")} UNION SELECT new FROM pairs WHERE {_credential("old")} OR {_credential("new")}""")
def tainted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return T.tainted_paths(c, T.pair_renames(c, hints(spark, sf_dir)))


@query(f"""WITH {TREES_SQL}, k AS (SELECT c.path, CASE WHEN p.old IS NOT NULL THEN 'renamed' ELSE change END AS change, p.old AS old_path,
  CASE WHEN c.path LIKE 'build/%' THEN 'build' WHEN c.path LIKE 'moved/build/%' THEN 'moved/build' END AS folder FROM changes c LEFT JOIN pairs p ON c.path = p.new WHERE c.path NOT IN (SELECT old FROM pairs))
SELECT path, change, old_path, 1 AS files FROM k WHERE folder IS NULL UNION ALL SELECT folder, CASE WHEN min(change) = max(change) THEN min(change) ELSE 'modified' END, NULL, count(*) FROM k WHERE folder IS NOT NULL GROUP BY folder""")
def changed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir)
    return T.changed_entries(c, T.pair_renames(c, hints(spark, sf_dir)))


def changed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = both(spark, sf_dir)
    modified = changes(spark, sf_dir).where("change = 'modified'").select("path")
    return modified.join(base.select("path", F.col("content").alias("before")), "path").join(head.select("path", F.col("content").alias("after")), "path")


@query()
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hunks(changed_texts(spark, sf_dir))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.diff_sizes(diff_hunks(spark, sf_dir))


@query(f"""WITH {TREES_SQL}, l AS (SELECT c.path, {lines_sql("b.content")}[-3:] AS l FROM changes c JOIN base b ON b.path = c.path WHERE change = 'modified')
SELECT path, 1 AS hunks, 1 AS additions, 0 AS deletions, round((list_sum(list_transform(l, lambda x: length(x) + 2)) + length('Added line token_name here.') + 2) / 3.5, 6) AS tokens FROM l""")
def diff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed text has a line more at its end: three lines before it and the line itself are its hunk."""
    return sizes(spark, sf_dir).withColumn("tokens", F.round("tokens", 6))


@query()
def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each folder, files in review order within all the limits."""
    s = sizes(spark, sf_dir).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("lines", F.col("additions") + F.col("deletions")).withColumn("files", F.lit(1))
    placed = s.select("folder", "path", F.concat(T.review_rank(F.col("path")), F.lit(":"), "path").alias("place"), "files", "lines", "hunks", "tokens")
    return T.select_within(placed, {"files": T.MOST_FILES, "lines": T.MOST_LINES, "hunks": T.MOST_HUNKS, "tokens": float(T.MOST_TOKENS)}, "folder")


@query("""WITH r AS (SELECT source, doc_id, length(text) / 3.5 AS tokens, sum(length(text) / 3.5) OVER w AS used, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, round(tokens, 6) AS tokens FROM r WHERE used <= 20000 AND n <= 30""")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("source", "doc_id", (F.length("text") / 3.5).alias("tokens"), F.col("doc_id").alias("place"))
    return T.longest_prefix(d, 20_000, 30, "source").select("source", "doc_id", F.round("tokens", 6).alias("tokens"))


@query("""WITH w AS (SELECT DISTINCT source || '/' || doc_id AS path, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS name FROM documents),
nm AS (SELECT item_id, 'item/' || item_id AS own, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 8))) AS name FROM benchmark),
h AS (SELECT item_id, path, count(DISTINCT w.name) AS names FROM w JOIN nm ON w.name = nm.name GROUP BY ALL)
SELECT item_id, path, names, CAST(row_number() OVER (PARTITION BY item_id ORDER BY names DESC, path) AS INT) AS place FROM h QUALIFY place <= 8""")
def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), lambda x: F.length(x) >= 8)
    names = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), F.explode(words).alias("name"))
    return T.related_files(docs, names, 8, "item_id")


@query("""WITH d AS (SELECT l_orderkey AS path, min(l_linenumber) AS start_line, max(l_linenumber) AS end_line FROM lineitem GROUP BY 1)
SELECT path, start_line, end_line FROM d WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = d.path AND l.l_returnflag = 'R' AND l.l_linenumber BETWEEN d.start_line AND d.end_line)""")
def declarations_with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    declared = l.groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))
    return T.holding_changed_lines(declared, l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")))


@query(f"WITH {TREES_SQL} SELECT path, content_sha256 FROM (SELECT path, sha256(content) AS content_sha256 FROM head h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = h.path AND b.sha256 = h.sha256))")
def unchanged_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = both(spark, sf_dir)
    return head.join(base.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path", F.sha2("content", 256).alias("content_sha256"))


OVERLAY_SQL = """f AS (SELECT CASE WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN 'n/' ELSE 'o/' END || doc_id AS path, doc_id, text FROM documents),
e1 AS (SELECT *, doc_id % 3 = 0 AS edited, doc_id % 3 = 0 AND (length(text) - length(replace(text, 'license', ''))) / 7 = 1 AS first FROM f),
e2 AS (SELECT *, CASE WHEN first THEN replace(text, 'license', 'permit') ELSE text END AS t1 FROM e1),
e3 AS (SELECT *, edited AND (length(t1) - length(replace(t1, 'permit', ''))) / 6 = 1 AS second FROM e2),
e4 AS (SELECT *, CASE WHEN second THEN replace(t1, 'permit', 'grant') ELSE t1 END AS content FROM e3)"""


def overlaid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Renames of every seventh document, half of them onto paths that are taken, and two edits each of every third."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    i = F.col("doc_id").cast("string")
    old, new = F.concat(F.lit("o/"), i), F.concat(F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 14 != 0), "n/").otherwise("o/"), i)
    edit = lambda n, find, put: docs.where("doc_id % 3 = 0").select(new.alias("path"), F.lit(n).alias("position"), F.lit(find).alias("find"), F.lit(put).alias("replace"))
    one = lambda *paths: spark.range(1).select(F.explode(F.array(*map(F.lit, paths))).alias("path"))
    return T.overlay(
        docs.select(old.alias("path"), F.col("text").alias("content")),
        docs.where("doc_id % 7 = 0").select(old.alias("old"), F.when(F.col("doc_id") % 14 == 0, "o/1").otherwise(new).alias("new")),
        edit(2, "permit", "grant").unionByName(edit(1, "license", "permit")).unionByName(one("nowhere").select("path", F.lit(1).alias("position"), F.lit("a").alias("find"), F.lit("b").alias("replace"))),
        one("extra", "o/2").withColumn("content", F.lit("added")),
        docs.where("doc_id % 5 = 0").select(new.alias("path")).unionByName(one("absent", "extra")),
    )


@query(f"WITH {OVERLAY_SQL} SELECT path, sha256(content) AS content_sha256 FROM e4 WHERE doc_id % 5 <> 0")
def tree_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaid(spark, sf_dir)[0].select("path", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH {OVERLAY_SQL} SELECT 'rename' AS step, 'o/' || doc_id AS path, 'already exists' AS fault FROM f WHERE doc_id % 14 = 0
UNION ALL SELECT 'edit', path, 'edit 1 matches ' || CAST((length(text) - length(replace(text, 'license', ''))) // 7 AS INT) || ' times' FROM e4 WHERE edited AND NOT first
UNION ALL SELECT 'edit', path, 'edit 2 matches ' || CAST((length(t1) - length(replace(t1, 'permit', ''))) // 6 AS INT) || ' times' FROM e4 WHERE edited AND NOT second
UNION ALL SELECT * FROM (VALUES ('edit', 'nowhere', 'no such file'), ('add', 'o/2', 'already exists'), ('remove', 'absent', 'no such file'))""")
def overlay_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaid(spark, sf_dir)[1]


TESTED_SQL = """f AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'tests/test_d' || (doc_id % 90) || '_' || doc_id || '.py' WHEN doc_id % 4 = 1 THEN 'tests/test_d' || (doc_id + 1) || '.py' ELSE 'src/d' || doc_id || '.py' END AS path, doc_id, text AS content FROM documents),
c AS (SELECT path FROM f WHERE doc_id % 9 = 2), nm AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 11)) AS name FROM benchmark),
t AS (SELECT * FROM f WHERE path LIKE 'tests/%' AND path NOT IN (SELECT path FROM c))"""


@query(f"""WITH {TESTED_SQL}, w AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM t), h AS (SELECT path, count(*) AS names, min(name) AS first FROM w JOIN nm USING (name) GROUP BY path),
s AS (SELECT regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS subject, min(path) AS o FROM c WHERE path NOT LIKE 'tests/%' GROUP BY 1),
n AS (SELECT path, o FROM (SELECT path, regexp_extract(string_split(path, '/')[-1], '^test_(.+)\\.py$', 1) AS subject FROM t WHERE path NOT IN (SELECT path FROM h)) JOIN s USING (subject)),
b AS (SELECT path, 'refers to ' || first AS reason, names FROM h UNION ALL SELECT path, 'named after ' || o, 0 FROM n)
SELECT path, reason, names, CAST(row_number() OVER (ORDER BY names DESC, path) AS INT) AS place FROM b QUALIFY place <= 40""")
def candidate_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, names = tested(spark, sf_dir)
    return T.candidate_tests(f, f.where("doc_id % 9 = 2"), names, 40)


def tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as sources and tests, and the names that changed."""
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("tests/test_d"), i % 90, F.lit("_"), i, F.lit(".py"))).when(i % 4 == 1, F.concat(F.lit("tests/test_d"), i + 1, F.lit(".py"))).otherwise(F.concat(F.lit("src/d"), i, F.lit(".py")))
    f = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", path.alias("path"), F.col("text").alias("content"))
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= 11)
    return f, table(spark, sf_dir, "benchmark", "text").select(F.explode(words).alias("name"))


@query(f"""WITH {TESTED_SQL}, w AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM t), h AS (SELECT path, count(*) AS names FROM w JOIN nm USING (name) GROUP BY path),
s AS (SELECT regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS subject FROM c WHERE path NOT LIKE 'tests/%' GROUP BY 1),
n AS (SELECT path FROM (SELECT path, regexp_extract(string_split(path, '/')[-1], '^test_(.+)\\.py$', 1) AS subject FROM t WHERE path NOT IN (SELECT path FROM h)) JOIN s USING (subject)),
b AS (SELECT path, row_number() OVER (ORDER BY names DESC, path) AS place FROM (SELECT path, names FROM h UNION ALL SELECT path, 0 FROM n) QUALIFY place <= 5),
fl AS (SELECT path, {lines_sql("content")} AS l FROM f JOIN b USING (path)), e AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM fl),
m AS (SELECT DISTINCT path, n FROM (SELECT path, n, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM e) JOIN nm USING (name)),
tw AS (SELECT path, min(n) AS a, max(n) AS z FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY n) <= 2) GROUP BY path),
p AS (SELECT path, l, CASE WHEN a IS NULL THEN 1 ELSE greatest(1, a - 6) END AS s, CASE WHEN a IS NULL THEN least(len(l), 13) ELSE least(len(l), z + 6, greatest(1, a - 6) + 39) END AS e FROM fl LEFT JOIN tw USING (path) WHERE len(l) > 0)
SELECT path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, sha256(array_to_string(l[s:e], '\n')) AS excerpt_sha256 FROM p""")
def candidate_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpts of the first five candidate tests, around the changed names that they hold."""
    f, names = tested(spark, sf_dir)
    first = T.candidate_tests(f, f.where("doc_id % 9 = 2"), names, 5)
    return T.excerpts(first, f, names).withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS repository_id, l_partkey % 50 AS commit, l_linenumber % 2 AS version FROM lineitem)
SELECT repository_id, commit, version, count(*) AS requests, CASE WHEN EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'R' AND s.l_suppkey = r.repository_id AND s.l_partkey % 50 = r.commit AND s.l_linenumber % 2 = r.version) THEN 'reuse'
  WHEN EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'A' AND s.l_linestatus = 'F' AND s.l_quantity < 10 AND s.l_suppkey = r.repository_id AND s.l_partkey % 50 = r.commit) THEN 'skip' ELSE 'build' END AS decision FROM r GROUP BY ALL""")
def build_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").select(  # noqa: E741
        F.col("l_suppkey").alias("repository_id"), (F.col("l_partkey") % 50).alias("commit"), (F.col("l_linenumber") % 2).alias("version"),
        F.when(F.col("l_returnflag") == "R", "ready").otherwise("other").alias("status"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)).alias("permanent"), F.when(F.col("l_linestatus") == "F", "syntax").otherwise("access").alias("error"),
    )
    requests = l.groupBy("repository_id", "commit", "version").agg(F.count(F.lit(1)).alias("requests"))
    return T.build_decisions(requests, l, l)


@query("""WITH w AS (SELECT item_id, unnest(t) AS name, generate_subscripts(t, 1) AS n FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM benchmark)),
f AS (SELECT item_id, name, min(n) AS n FROM w WHERE length(name) >= 4 AND lower(name) NOT IN ('main', 'init', '__init__', 'get', 'set', 'run', 'test') GROUP BY ALL)
SELECT item_id, name, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n) AS INT) AS place FROM f QUALIFY place <= 30""")
def useful_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return T.useful_names(table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.posexplode(words).alias("position", "name")), "item_id")


NAMES_SQL = """nm AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 8))) AS name FROM benchmark)"""


@query(f"""WITH {NAMES_SQL}, w AS (SELECT DISTINCT source || '/' || doc_id AS path, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM documents),
r AS (SELECT item_id, path FROM (SELECT item_id, path, count(DISTINCT w.name) AS names FROM w JOIN nm ON w.name = nm.name GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY names DESC, path) <= 8),
fl AS (SELECT source || '/' || doc_id AS path, {lines_sql("text")} AS l FROM documents),
e AS (SELECT item_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM r JOIN fl USING (path)),
m AS (SELECT DISTINCT e.item_id, e.path, n FROM (SELECT item_id, path, n, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM e) e JOIN nm ON nm.item_id = e.item_id AND nm.name = e.name),
t AS (SELECT item_id, path, min(n) AS a, max(n) AS b FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id, path ORDER BY n) <= 2) GROUP BY ALL),
s AS (SELECT item_id, path, l, greatest(1, a - 6) AS s, b FROM t JOIN fl USING (path))
SELECT item_id, path, CAST(s AS INT) AS start_line, CAST(least(len(l), b + 6, s + 39) AS INT) AS end_line, sha256(array_to_string(l[s:least(len(l), b + 6, s + 39)], '\n')) AS excerpt_sha256 FROM s""")
def related_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), lambda x: F.length(x) >= 8)
    names = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.explode(words).alias("name"))
    return T.excerpts(related_files(spark, sf_dir), docs, names, "item_id").withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")


@query(f"""WITH {ONCE_SQL}, h AS (SELECT review, 'p' || n AS path, pk % 3 AS added, sk % 2 AS removed, CAST(pk % 50 + 1 AS INT) AS a, CAST(sk % 40 + 1 AS INT) AS b, q AS tokens, n AS place FROM one),
c AS (SELECT review, path, 0 AS turn, 'after' AS side, a AS s, a + 4 AS e FROM h WHERE added > 0 UNION ALL SELECT review, path, 1, 'before', b, b + 2 FROM h WHERE removed > 0),
x AS (SELECT review, row_number() OVER (PARTITION BY review ORDER BY path, turn) AS rank, 'change' AS source_type, side, path, s, e FROM c),
d AS (SELECT review, sum(tokens) AS diff, CAST(sum(CASE WHEN added > 0 THEN 1 ELSE 0 END + CASE WHEN removed > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM h GROUP BY review),
k AS (SELECT review, place, sum(tokens * 2) OVER (PARTITION BY review ORDER BY place ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY review ORDER BY place) AS m FROM h WHERE review % 4 < 3),
u AS (SELECT * FROM x UNION ALL SELECT k.review, n + m, CASE WHEN place < 4 THEN 'reference' ELSE 'test' END, 'after', 'c' || place, 1, 5 FROM k JOIN d ON k.review = d.review WHERE used <= 300 - diff AND m + n <= 8)
SELECT review, 'E' || rank AS label, CAST(rank AS INT) AS rank, source_type, side, path, s AS start_line, e AS end_line FROM u""")
def labelled_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n, a, b = lines_once(spark, sf_dir), F.col("n"), (F.col("pk") % 50 + 1).cast("int"), (F.col("sk") % 40 + 1).cast("int")  # noqa: E741
    made = l.select("review", F.concat(F.lit("p"), n.cast("string")).alias("path"), F.lit(0).alias("hunk"), (F.col("pk") % 3).alias("added"), (F.col("sk") % 2).alias("removed"), a.alias("after_start"), (a + 4).alias("after_end"), b.alias("before_start"), (b + 2).alias("before_end"), F.col("q").alias("tokens"))
    context = l.where("review % 4 < 3").select("review", n.alias("place"), F.when(n < 4, "reference").otherwise("test").alias("source_type"), F.concat(F.lit("c"), n.cast("string")).alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"), (F.col("q") * 2).alias("tokens"))
    return T.labelled_evidence(made, context, 300.0, "review", most=8)
