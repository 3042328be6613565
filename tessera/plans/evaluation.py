"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evaluation as V
from tessera.plans.common import Registry
from tessera.plans.retrieval import RANKS_SQL, ranked_chunks
from tessera.sources.tables import ONCE_SQL, lines_once, table

query = Registry()


@query(f"""WITH {RANKS_SQL}, lab AS (SELECT DISTINCT question_id, path, start_line + 10 AS start_line, end_line + 70 AS end_line FROM ranked WHERE place IN (1, 4, 9)),
hit AS (SELECT l.question_id, l.path, l.start_line, l.end_line, max(CASE WHEN r.path IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM lab l LEFT JOIN (SELECT * FROM ranked WHERE place <= 5) r ON l.question_id = r.question_id AND l.path = r.path AND l.start_line <= r.end_line AND r.start_line <= l.end_line GROUP BY ALL)
SELECT question_id, round(avg(hit), 9) AS recall FROM hit GROUP BY question_id""")
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_chunks(spark, sf_dir)
    labelled = ranked.where("place IN (1, 4, 9)").select("question_id", "path", (F.col("start_line") + 10).alias("start_line"), (F.col("end_line") + 70).alias("end_line"))
    return V.recall_at_k(labelled, ranked.withColumnRenamed("place", "rank")).select("question_id", F.round("recall", 9).alias("recall"))


@query("""WITH r AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(*) FILTER (WHERE toxic = 0), 0) AS clean, count(*) FILTER (WHERE quality = 0 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0) AS abstained, count(*) FILTER (WHERE quality = 1 AND toxic = 9) / nullif(count(*) FILTER (WHERE toxic = 9), 0) AS none FROM labels)
SELECT round(clean, 9) AS clean, round(abstained, 9) AS abstained, none, clean >= 0.8 AS clean_met, abstained >= 0.8 AS abstained_met, none >= 0.8 AS none_met FROM r""")
def rates_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    r = table(spark, sf_dir, "labels").agg(V.rate(q == 1, t == 0).alias("clean"), V.rate(q == 0, t == 1).alias("abstained"), V.rate(q == 1, t == 9).alias("none"))
    met = [V.target_met(F.col(c), 0.8).alias(f"{c}_met") for c in ("clean", "abstained", "none")]
    return r.select(F.round("clean", 9).alias("clean"), F.round("abstained", 9).alias("abstained"), "none", *met)


@query("""SELECT event_type AS category, count(*) AS calls, count(*) FILTER (WHERE event_id % 50 = 0 AND event_type = 'error') AS errors, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  quantile_disc(value, 0.95) < CASE event_type WHEN 'view' THEN 400.0 WHEN 'click' THEN 1e9 ELSE 1000.0 END AND count(*) FILTER (WHERE event_id % 50 = 0 AND event_type = 'error') = 0 AS passed FROM events GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    kinds = ("click", "view", "purchase", "error", "signup", "login", "logout", "search")
    limits = {k: {"view": 400.0, "click": 1e9}.get(k, 1000.0) for k in kinds}
    return V.latency_summary(e.select(F.col("event_type").alias("category"), F.col("value").alias("seconds"), ((F.col("event_id") % 50 == 0) & (F.col("event_type") == "error")).alias("failed")), limits)


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1")
def percentile_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice)"), 6).alias("p95"))


@query("""WITH l AS (SELECT c_nationkey AS users, avg(c_acctbal) < 4700 AS passed FROM customer GROUP BY 1) SELECT max(users) AS users FROM l WHERE passed AND users < coalesce((SELECT min(users) FROM l WHERE NOT passed), 1000000)""")
def highest_passing_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").groupBy(F.col("c_nationkey").alias("users")).agg((F.avg("c_acctbal") < 4700).alias("passed"))
    return V.highest_passing_level(levels)


@query("""WITH e AS (SELECT DISTINCT ON (l_returnflag, l_orderkey) l_returnflag AS tool, l_orderkey AS url, l_orderkey % 3 AS tp, l_orderkey % 2 AS fp, l_orderkey % 5 AS fn, l_orderkey % 7 = 0 AS skipped FROM lineitem), t AS (SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (WHERE url % 4 = 1) AS older FROM e WHERE NOT skipped GROUP BY tool)
SELECT tool, tp, fp, fn, older, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM t""")
def tool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    e = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").select(F.col("l_returnflag").alias("tool"), k.alias("url"), (k % 3).alias("tp"), (k % 2).alias("fp"), (k % 5).alias("fn"), (k % 7 == 0).alias("skipped"), F.array(F.lit("b"), F.lit("a")).alias("judged"))
    golden = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("comments"))
    return V.tool_totals(e, golden).withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


@query("""WITH u AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(value) AS DOUBLE) AS a, count(*) AS b FROM events GROUP BY 1)
SELECT day, round((a * CASE WHEN day >= DATE '2024-01-15' THEN 3.0 ELSE 2.0 END + b * CASE WHEN day >= DATE '2024-01-15' THEN 15.0 ELSE 10.0 END) / 1e6, 9) AS cost FROM u""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events", "ts", "value").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("tokens_in"), F.count(F.lit(1)).alias("tokens_out"))
    prices = spark.sql("SELECT * FROM VALUES (DATE '2023-01-01', 2.0D, 10.0D), (DATE '2024-01-15', 3.0D, 15.0D) AS p(from_day, price_in, price_out)")
    return V.usage_cost(u, prices).select("day", F.round("cost", 9).alias("cost"))


@query("""WITH f AS (SELECT doc_id, 'd' || doc_id AS path, text AS content, string_split(text, '\n') AS l FROM documents),
c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'gone' ELSE path END AS path, CASE WHEN doc_id % 10 = 4 THEN 'old' ELSE 'now' END AS commit, 1 AS s, CASE WHEN doc_id % 10 = 5 THEN 100000 ELSE 1 END AS e, CASE WHEN doc_id % 10 = 6 THEN 'x' ELSE l[1] END AS excerpt FROM f)
SELECT c.doc_id, CASE WHEN f.path IS NOT NULL AND commit <> 'now' THEN 'commit' WHEN f.path IS NULL THEN 'file' WHEN e > len(l) THEN 'range' WHEN array_to_string(l[s:e], '\n') <> excerpt THEN 'excerpt' END AS problem FROM c LEFT JOIN f ON c.path = f.path""")
def citation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    i = F.col("doc_id")
    path = F.concat(F.lit("d"), i.cast("string"))
    files = docs.select(path.alias("path"), F.col("text").alias("content"), F.lit("now").alias("commit"))
    c = docs.select("doc_id", F.when(i % 10 == 3, "gone").otherwise(path).alias("path"), F.when(i % 10 == 4, "old").otherwise("now").alias("commit"), F.lit(1).alias("start_line"), F.when(i % 10 == 5, 100_000).otherwise(1).alias("end_line"), F.when(i % 10 == 6, "x").otherwise(F.split("text", "\n")[0]).alias("excerpt"))
    return V.citation_problems(c, files).select("doc_id", "problem")


@query("""WITH d AS (SELECT DISTINCT concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS defect_id, l_orderkey AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'after' ELSE 'before' END AS side, CAST(l_suppkey % 3 AS VARCHAR) AS path, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem WHERE l_returnflag = 'R')
SELECT defect_id, EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag <> 'R' AND r.l_orderkey = d.item_id AND CASE WHEN r.l_linenumber % 2 = 0 THEN 'after' ELSE 'before' END = d.side AND r.l_linestatus = 'O' AND CAST(r.l_suppkey % 3 AS VARCHAR) = d.path AND d.s <= r.l_linenumber + 2 AND r.l_linenumber <= d.e) AS found FROM d""")
def defects_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")  # noqa: E741
    side = F.when(F.col("l_linenumber") % 2 == 0, "after").otherwise("before").alias("side")
    n = F.col("l_linenumber")
    d = l.where("l_returnflag = 'R'").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("defect_id"), F.col("l_orderkey").alias("item_id"), side, (F.col("l_suppkey") % 3).cast("string").alias("path"), n.alias("start_line"), (n + 1).alias("end_line")).distinct()
    r = l.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("item_id"), side, (F.col("l_suppkey") % 3).cast("string").alias("path"), n.alias("start_line"), (n + 2).alias("end_line"), F.when(F.col("l_linestatus") == "O", "high").otherwise("low").alias("severity"))
    return V.defects_found(d, r).select("defect_id", "found")


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_returnflag").select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("position"), severity.alias("severity"), (F.col("l_returnflag") == "R").alias("cut"), F.concat(F.lit("area"), F.col("l_suppkey") % 3).alias("area_name"))


RISKS_SQL = "risks AS (SELECT l_orderkey AS review, l_linenumber AS position, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS severity, l_returnflag = 'R' AS cut, 'area' || (l_suppkey % 3) AS area_name FROM lineitem)"
_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(f"WITH {RISKS_SQL} SELECT review, position, severity, 'R' || row_number() OVER (PARTITION BY review ORDER BY {_RANK}, position) AS label FROM risks")
def ordered_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ordered_risks(risks(spark, sf_dir), "review").select("review", "position", "severity", "label")


@query(f"WITH {RISKS_SQL} SELECT review, arg_min(severity, ({_RANK}, position)) AS overall, bool_or(cut) AS partial FROM risks GROUP BY review")
def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overall_risk(risks(spark, sf_dir), "review")


@query(f"""WITH {RISKS_SQL}, g AS (SELECT review, area_name AS area, min(position) AS f, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS points FROM risks GROUP BY ALL)
SELECT review, area, CAST(row_number() OVER (PARTITION BY review ORDER BY f, area) AS INT) AS place, points FROM g""")
def points_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = risks(spark, sf_dir).withColumn("point", F.col("position").cast("string"))
    return V.grouped_by_area(p, F.col("area_name"), "review").withColumn("points", F.array_join("points", ","))


@query("""WITH e AS (SELECT l_orderkey AS k, array_agg(DISTINCT 'E' || l_linenumber) AS known FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
r AS (SELECT l_orderkey AS k, array_agg(DISTINCT 'E' || l_linenumber) AS cited FROM lineitem GROUP BY 1), u AS (SELECT r.k, list_sort(list_filter(cited, lambda x: NOT list_contains(coalesce(known, []), x))) AS u FROM r LEFT JOIN e ON r.k = e.k)
SELECT k AS review, array_to_string(u, ',') AS unknown FROM u WHERE len(u) > 0""")
def unknown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select(F.col("l_orderkey").alias("review"), F.concat(F.lit("E"), "l_linenumber").alias("label"), "l_returnflag")  # noqa: E741
    results = l.groupBy("review").agg(F.collect_set("label").alias("cited"))
    return V.unknown_citations(results, l.where("l_returnflag = 'N'"), "review").select("review", F.array_join("unknown", ",").alias("unknown"))


@query("""WITH c AS (SELECT conv_id AS item_id, string_agg(text, ' | ' ORDER BY turn, text) FILTER (WHERE role <> 'user') AS x, arg_min(text, (turn, text)) AS claim FROM conversations GROUP BY 1)
SELECT item_id, claim, CASE WHEN length(coalesce(x, '')) > 200 THEN substring(x, 1, 199) || '…' ELSE coalesce(x, '') END AS excerpts FROM c""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text")))), lambda x: x["text"])
    return V.audit_rows(c.groupBy(F.col("conv_id").alias("item_id")).agg(F.min_by("text", F.struct("turn", "text")).alias("claim"), said.alias("excerpts")))


@query("""SELECT doc_id, source, CAST(round AS INT) AS round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS round FROM documents) WHERE round <= 3""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.round_robin_sample(table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id", 7, 3)


@query()
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.set_digest(table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text")


@query("SELECT 'all' AS selection, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role UNION ALL SELECT 'first', role, count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations WHERE turn = 0 GROUP BY role")
def two_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "turn", "role", "text")
    # one pass: each row goes to the selections that it is in
    chosen = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("turn") == 0, "first")), lambda x: x.isNotNull()))
    return c.select(chosen.alias("selection"), "role", F.length("text").alias("n")).groupBy("selection", "role").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("chars"))


@query("SELECT text AS value, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY text")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").groupBy(F.col("text").alias("value")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))


@query("""WITH i AS (SELECT l_orderkey AS review, l_linenumber AS item, CASE WHEN l_linenumber % 3 = 0 THEN ['p' || (l_suppkey % 5)] ELSE [] END AS paths, CASE WHEN l_linenumber % 4 = 1 THEN ['R' || l_linenumber, 'R' || (l_linenumber + 2)] ELSE [] END AS ids FROM lineitem),
k AS (SELECT l_orderkey AS review, list(DISTINCT 'p' || (l_partkey % 5)) AS changed, list(DISTINCT 'R' || l_linenumber) AS listed FROM lineitem GROUP BY 1),
u AS (SELECT i.review, item, paths, ids, changed, list_filter(ids, lambda x: NOT list_contains(listed, x)) AS unknown FROM i JOIN k ON i.review = k.review)
SELECT review, item, CASE WHEN len(unknown) > 0 THEN 'unlisted risks: ' || array_to_string(unknown, ', ') WHEN len(ids) = 0 AND NOT list_has_any(paths, changed) THEN 'no changed file and no listed risk' END AS problem FROM u""")
def checklist_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").withColumnRenamed("l_orderkey", "review")  # noqa: E741
    n, none = F.col("l_linenumber"), F.array().cast("array<string>")
    label = lambda c: F.concat(F.lit("R"), c.cast("string"))
    items = l.select("review", n.alias("item"), F.when(n % 3 == 0, F.array(F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")))).otherwise(none).alias("paths"), F.when(n % 4 == 1, F.array(label(n), label(n + 2))).otherwise(none).alias("risk_ids"))
    changed = l.select("review", F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("path"))
    return V.checklist_problems(items, changed, l.select("review", label(n).alias("label")), "review")


@query(f"""WITH {RISKS_SQL}, g AS (SELECT review, arg_min(severity, {_RANK}) AS gravest FROM risks WHERE position % 2 = 0 GROUP BY 1),
o AS (SELECT o_orderkey AS review, CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 3 = 1 THEN 'high' ELSE 'medium' END AS level, o_orderkey % 5 = 0 AS partial, o_orderkey % 10 = 0 AS cut FROM orders)
SELECT o.review, CASE WHEN level <> coalesce(gravest, 'none') THEN 'level: expected ' || coalesce(gravest, 'none') WHEN partial <> cut THEN 'partial: expected ' || CAST(cut AS VARCHAR) END AS problem FROM o LEFT JOIN g ON o.review = g.review""")
def level_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("review"), F.when(k % 3 == 0, "none").when(k % 3 == 1, "high").otherwise("medium").alias("level"), (k % 5 == 0).alias("partial"), (k % 10 == 0).alias("cut"))
    return V.level_problems(results, risks(spark, sf_dir).where("position % 2 = 0"), "review")


@query("""WITH l AS (SELECT DISTINCT user_id % 40 AS users, event_type AS run FROM events WHERE user_id % 10 < 3), f AS (SELECT arg_min(run, (users, run)) AS first FROM l)
SELECT users, run, run = first AS same_run, count(*) OVER (PARTITION BY users) > 1 AS twice FROM l, f""")
def levels_of_one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "events", "user_id", "event_type").where("user_id % 10 < 3").select((F.col("user_id") % 40).alias("users"), F.col("event_type").alias("run")).distinct()
    # of levels that stand twice the first run by name is the lowest
    return V.of_one_run(levels.withColumn("n", F.col("users")).withColumn("users", F.struct("n", "run")), ["run"]).select("n", "run", "same_run").withColumnRenamed("n", "users").join(V.of_one_run(levels, ["run"]).select("users", "run", "twice"), ["users", "run"])


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS round FROM documents)
SELECT doc_id, source, CAST(round AS INT) AS round FROM r ORDER BY round, sha256('7:' || source), source LIMIT 30""")
def sample_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sample_until(table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id", 7)


@query("""WITH j AS (SELECT l_orderkey AS review, CAST(l_linenumber AS INT) AS n, '{"k": ' || l_linenumber || ', "x": "y"}' AS p, '{"k": "' || l_returnflag || '", "z": [1, 2]}' AS q FROM lineitem)
SELECT review, n, array_to_string(list_transform(list_sort(list_transform(list_distinct(['E' || n, 'E1', 'E' || (n * 7), 'x]y', 'EZ']), lambda x: {'n': length(x), 'x': x})), lambda x: x.x), ',') AS cited, '{"k":"' || json_extract_string(q, '$.k') || '","x":"y","z":[1,2]}' AS merged FROM j""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    n = F.col("l_linenumber")
    body = F.format_string('{"a": {"evidence_ids": ["E%d", "E1", "x]y", 5], "t": "\\"evidence_ids\\": [\\"no\\"]"}, "b": [[{"evidence_ids": ["E%d"]}], {"evidence_ids": {"evidence_ids": ["\\u0045Z"]}}]}', n, n * 7)
    first, second = F.format_string('{"k": %d, "x": "y"}', n), F.format_string('{"k": "%s", "z": [1, 2]}', F.col("l_returnflag"))
    rows = l.select(F.col("l_orderkey").alias("review"), n.cast("int").alias("n"), body.alias("result"), X.merged_json(first, second).alias("merged"))
    return rows.select("review", "n", F.array_join(V.cited("result"), ",").alias("cited"), "merged")


@query(f"""WITH {ONCE_SQL}, p AS (SELECT review, n AS position, CASE pk % 4 WHEN 0 THEN [] WHEN 1 THEN ['E1'] WHEN 2 THEN ['E9', 'E2', 'E8'] ELSE ['E2', 'E3'] END AS cited FROM one),
e AS (SELECT review, list('E' || n) AS known, list('E' || n) FILTER (WHERE n % 2 = 1) AS change FROM one GROUP BY 1),
j AS (SELECT p.review, position, list_filter(cited, lambda x: NOT list_contains(known, x)) AS unknown, NOT coalesce(list_has_any(cited, change), false) AS no_change FROM p JOIN e ON p.review = e.review)
SELECT review, position, array_to_string(unknown, ',') AS unknown, no_change FROM j WHERE len(unknown) > 0 OR no_change""")
def citation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n, kind, labels = lines_once(spark, sf_dir), F.col("n"), F.col("pk") % 4, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")  # noqa: E741
    cited = F.when(kind == 0, labels()).when(kind == 1, labels("E1")).when(kind == 2, labels("E9", "E2", "E8")).otherwise(labels("E2", "E3"))
    evidence = l.select("review", F.concat(F.lit("E"), n.cast("string")).alias("label"), (n % 2 == 1).alias("is_change"))
    return V.citation_faults(l.select("review", n.alias("position"), cited.alias("cited")), evidence, "review").withColumn("unknown", F.array_join("unknown", ","))


@query(f"""WITH {ONCE_SQL}, k AS (SELECT review, n - 1 AS old, row_number() OVER (PARTITION BY review ORDER BY n) - 1 AS new FROM one WHERE pk % 3 > 0),
i AS (SELECT review, n AS item, unnest([n % 4, 0, n - 1]) AS old, unnest([0, 1, 2]) AS pos FROM one),
j AS (SELECT i.review, item, string_agg(CAST(new AS VARCHAR), ',' ORDER BY pos) AS indexes FROM i LEFT JOIN k ON i.review = k.review AND i.old = k.old GROUP BY i.review, item) SELECT review, item, coalesce(indexes, '') AS indexes FROM j""")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n = lines_once(spark, sf_dir), F.col("n")  # noqa: E741
    items = l.select("review", n.alias("item"), F.array(n % 4, F.lit(0), n - 1).alias("indexes"))
    return V.renumbered(items, l.where("pk % 3 > 0").select("review", (n - 1).alias("position")), "review").withColumn("indexes", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ","))


@query()
def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews: their lines are risks, points and items of the checklist."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("review"), F.concat(F.lit("Order "), "o_orderkey").alias("overview"), (F.col("o_orderstatus") == "P").alias("partial"), (F.col("o_orderkey") % 9).alias("changed_files"), (F.col("o_orderkey") % 3).alias("omitted"))
    l, n = lines_once(spark, sf_dir), F.col("n")  # noqa: E741
    lines = l.select("review", n.cast("int").alias("position"), "pk", "sk", "q", F.concat(F.lit("line "), n.cast("string")).alias("text"))
    severity = F.when(F.col("q") > 40, "high").when(F.col("q") > 20, "medium").otherwise("low")
    risks = lines.where("pk % 3 > 0").select("review", "position", severity.alias("severity"), F.col("text").alias("title"))
    rules = lines.where("pk % 7 = 0").select("review", "position", F.lit("Credential file changed").alias("title"), F.concat(F.lit(".env"), F.col("position").cast("string")).alias("path"))
    points = lines.select("review", "position", F.concat(F.lit("area"), (F.col("sk") % 3).cast("string")).alias("area"), "text")
    path = lambda c: F.concat(F.lit("p"), c.cast("string"))
    paths = F.when(F.col("sk") % 2 == 0, F.array(path(F.col("position")), path(F.col("position") + 1), F.concat(F.lit("old"), F.col("position").cast("string")))).otherwise(F.array().cast("array<string>"))
    checklist = lines.select("review", "position", "text", paths.alias("paths"), F.array(F.col("position") + 1, F.lit(1), F.col("position") + 1).alias("risk_indexes"))
    reviewed = lines.where("position % 2 = 1").select("review", F.explode(F.array(path(F.col("position")), F.concat(F.lit("old"), F.col("position").cast("string")))).alias("name"), path(F.col("position")).alias("path"))
    return V.review_results(orders, risks, rules, points, checklist, reviewed, "review")
