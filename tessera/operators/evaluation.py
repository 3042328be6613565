"""Evaluation operators: recall, rates, percentiles, totals, cost, citations and defects."""

from __future__ import annotations

import json as json_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import with_meets


def rate(hit: Column, of: Column) -> Column:
    """Share of the rows ``of`` that ``hit``; null where there are none."""
    return F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of).cast("double"))


def target_met(value: Column, least: float) -> Column:
    """True, false, or null where nothing was measured."""
    return F.when(value.isNotNull(), value >= least)


def recall_at_k(labelled: DataFrame, retrieved: DataFrame, k: int = 5, key: str = "question_id") -> DataFrame:
    """``(key, recall)``: share of a question's labelled ranges that one of its first ``k`` retrieved ranges overlaps.

    Both are ``(key, path, start_line, end_line)``; retrieved ones have a ``rank``. Ranges are inclusive.
    """
    own = labelled.select(key, "path", "start_line", "end_line").distinct()
    hit = with_meets(own, retrieved.where(F.col("rank") <= k), "hit", key, "path")
    return hit.groupBy(key).agg(F.avg(F.col("hit").cast("int")).alias("recall"))


def latency_summary(calls: DataFrame, limits: dict[str, float], category: str = "category") -> DataFrame:
    """Calls, errors, p50 and p95 by nearest rank of each category; it passes below its limit without errors."""
    limit = None
    for name, value in limits.items():
        limit = F.when(F.col(category) == name, F.lit(float(value))) if limit is None else limit.when(F.col(category) == name, F.lit(float(value)))
    out = calls.groupBy(category).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seconds)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95"),
    )
    return out.withColumn("passed", (F.col("p95") < limit) & (F.col("errors") == 0))


def highest_passing_level(levels: DataFrame) -> DataFrame:
    """The last level ``(users, passed)`` that passes below the first that fails; null if none."""
    failing = levels.where("not passed").agg(F.min("users").alias("bad"))
    # one row
    return levels.where("passed").crossJoin(F.broadcast(failing)).where(F.col("bad").isNull() | (F.col("users") < F.col("bad"))).agg(F.max("users").alias("users"))


def tool_totals(evaluations: DataFrame, golden: DataFrame) -> DataFrame:
    """``(tool, tp, fp, fn, older, precision, recall)`` over evaluations that weren't skipped, one for each url.

    ``older`` counts those that were judged against another multiset of golden comments.
    """
    one = evaluations.where("not skipped").dropDuplicates(["tool", "url"])
    met = one.join(golden.select("url", F.array_sort("comments").alias("now")), "url")
    out = met.groupBy("tool").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(F.array_sort("judged") != F.col("now")).alias("older"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (day, tokens_in, tokens_out) with ``cost`` by the price that holds on its day.

    ``prices`` (from_day, price_in, price_out) for a million tokens; a few rows.
    """
    until = F.lead("from_day").over(Window.orderBy("from_day"))
    spans = prices.withColumn("to_day", until)
    meets = (F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    return usage.join(spans, meets, "left").withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6)


def citation_problems(citations: DataFrame, files: DataFrame) -> DataFrame:
    """``problem`` of each citation (path, commit, start_line, end_line, excerpt): the first test that it fails."""
    lines = F.split("content", "\n")
    own = F.array_join(F.slice(lines, F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    joined = citations.join(files.select("path", "content", F.col("commit").alias("indexed")), "path", "left")
    problem = (
        F.when(F.col("indexed").isNotNull() & (F.col("commit") != F.col("indexed")), "commit")
        .when(F.col("content").isNull(), "file")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size(lines)), "range")
        .when(own != F.col("excerpt"), "excerpt")
    )
    return joined.withColumn("problem", problem).drop("content", "indexed")


def defects_found(defects: DataFrame, risks: DataFrame) -> DataFrame:
    """``found``: whether a medium or high risk of the same item, side and path overlaps the defect's lines."""
    return with_meets(defects, risks.where(F.col("severity").isin("medium", "high")), "found", "item_id", "side", "path")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def ordered_risks(risks: DataFrame, *keys: str) -> DataFrame:
    """``label`` R1, R2, ... by severity, then position."""
    w = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "position")
    return risks.withColumn("label", F.concat(F.lit("R"), F.row_number().over(w)))


def overall_risk(risks: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, overall, partial)``: the gravest severity, and whether a limit cut the review."""
    return risks.groupBy(*keys).agg(F.min_by("severity", F.struct(severity_rank(F.col("severity")).alias("s"), F.col("position"))).alias("overall"), F.bool_or("cut").alias("partial"))


def grouped_by_area(points: DataFrame, area: Column, *keys: str) -> DataFrame:
    """``(*keys, area, place, points)``: points by area; areas and points in the order of their first position."""
    grouped = points.groupBy(*keys, area.alias("area")).agg(F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "point"))).alias("p"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "area"))
    return grouped.select(*keys, "area", place.alias("place"), F.transform("p", lambda x: x["point"]).alias("points"))


def unknown_citations(results: DataFrame, evidence: DataFrame, *keys: str) -> DataFrame:
    """Labels that a result cites and its evidence doesn't hold."""
    known = evidence.groupBy(*keys).agg(F.collect_set("label").alias("known"))
    joined = results.join(known, list(keys), "left")
    return joined.select(*keys, F.array_sort(F.array_except("cited", F.coalesce("known", F.array().cast("array<string>")))).alias("unknown")).where(F.size("unknown") > 0)


def audit_rows(claims: DataFrame, most: int = 200) -> DataFrame:
    """``(item_id, claim, excerpts)``: each claim with its cited excerpts, cut to ``most`` characters."""
    joined = F.array_join("excerpts", " | ")
    return claims.select("item_id", "claim", F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most - 1), F.lit("…"))).otherwise(joined).alias("excerpts"))


def round_robin_sample(rows: DataFrame, group: str, key: str, seed: int, rounds: int) -> DataFrame:
    """The first ``rounds`` rows of each group in a reproducible shuffled order: rounds over all groups."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return rows.withColumn("round", F.row_number().over(w)).where(F.col("round") <= rounds)


def set_digest(rows: DataFrame, name: str, content: str, fan: int = 64) -> DataFrame:
    """``digest`` of a set of named contents, order-free: a tree of digests over buckets by name.

    There are so many buckets that each holds about ``fan`` names, and each inner node has ``fan`` children, so
    no task gets more of a set than that at once, however large it is. An empty set has the digest of no text.
    """
    each = rows.select(F.xxhash64(F.col(name).cast("string")).alias("b"), F.col(name).cast("string").alias("n"), F.sha2(content, 256).alias("h"))
    levels, room = 1, fan * fan
    count = rows.count()
    while room < count:
        levels, room = levels + 1, room * fan
    joined = lambda parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: F.concat_ws("=", x["n"], x["h"])), "\n"), 256)
    node = lambda level: F.pmod(F.col("b"), F.lit(fan**level))
    for level in range(levels, -1, -1):
        each = each.groupBy(node(level).alias("b")).agg(joined(F.struct("n", "h")).alias("h")).withColumn("n", F.col("b").cast("string"))
    return each.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def checklist_problems(items: DataFrame, changed: DataFrame, risks: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, item, problem)``: why a checklist item ``(paths, risk_ids)`` refers to no listed risk or changed file; null where it does."""
    none = F.array().cast("array<string>")
    known = changed.groupBy(*keys).agg(F.collect_set("path").alias("changed"))
    listed = risks.groupBy(*keys).agg(F.collect_set("label").alias("listed"))
    joined = items.join(known, list(keys), "left").join(listed, list(keys), "left")
    ids, paths = F.coalesce("risk_ids", none), F.coalesce("paths", none)
    unknown = F.filter(ids, lambda x: ~F.array_contains(F.coalesce("listed", none), x))
    alone = (F.size(ids) == 0) & ~F.arrays_overlap(F.filter(paths, lambda x: x.isNotNull()), F.coalesce("changed", none))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit("unlisted risks: "), F.array_join(unknown, ", "))).when(alone, "no changed file and no listed risk")
    return joined.select(*keys, "item", problem.alias("problem"))


def level_problems(results: DataFrame, risks: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, problem)``: where ``level`` isn't the gravest listed risk, or ``partial`` not whether a limit cut the review."""
    gravest = risks.groupBy(*keys).agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("gravest"))
    expected = F.coalesce("gravest", F.lit("none"))
    problem = F.when(~F.col("level").eqNullSafe(expected), F.concat(F.lit("level: expected "), expected)).when(F.coalesce("partial", F.lit(False)) != F.col("cut"), F.concat(F.lit("partial: expected "), F.col("cut").cast("string")))
    return results.join(gravest, list(keys), "left").select(*keys, problem.alias("problem"))


def of_one_run(levels: DataFrame, run: list[str]) -> DataFrame:
    """``same_run``: whether a level's run columns are those of the lowest level, and ``twice`` whether its users stand twice."""
    first = levels.agg(F.min_by(F.struct(*run), "users").alias("first"))
    users = Window.partitionBy("users")
    same = F.struct(*run) == F.col("first")
    return levels.crossJoin(first).withColumn("same_run", same).withColumn("twice", F.count(F.lit(1)).over(users) > 1).drop("first")  # one row


def sample_until(rows: DataFrame, group: str, key: str, seed: int, least_rows: int = 30, least_groups: int = 10) -> DataFrame:
    """Rounds over all groups, one row of each, until ``least_rows`` rows of ``least_groups`` groups are taken, or all rows.

    The first round takes each group once, so so many rows hold as many groups where there are enough; else all rows are taken.
    """
    shuffled = lambda c: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")), 256)
    rounds = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(shuffled(key), key)))
    enough = rows.select(group).distinct().limit(least_groups).count() >= least_groups
    return rounds.orderBy("round", shuffled(group), group).limit(max(least_rows, least_groups)) if enough else rounds


def citation_faults(points: DataFrame, evidence: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, position, unknown, no_change)`` of points ``(*keys, position, cited)`` that fail.

    ``unknown`` are cited labels that the evidence ``(*keys, label, is_change)`` doesn't hold; ``no_change`` says that none
    cited is of a changed line. Labels are joined one by one, so no review's evidence is gathered.
    """
    each = points.select(*keys, "position", F.posexplode_outer("cited").alias("__at", "label"))
    known = evidence.groupBy(*keys, "label").agg(F.bool_or("is_change").alias("is_change"))
    joined = each.join(known, [*keys, "label"], "left")
    stray = F.collect_list(F.when(F.col("label").isNotNull() & F.col("is_change").isNull(), F.struct("__at", "label")))
    found = joined.groupBy(*keys, "position").agg(F.transform(F.array_sort(stray), lambda x: x["label"]).alias("unknown"), (~F.coalesce(F.bool_or("is_change"), F.lit(False))).alias("no_change"))
    return found.where((F.size("unknown") > 0) | F.col("no_change"))


def renumbered(items: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """``items`` (*keys, item, indexes) with positions of the rows that are kept: ``kept`` (*keys, position) are those rows, in
    their old positions from 0; indexes of rows that went are left out."""
    new = F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1
    moved = kept.select(*keys, F.col("position").alias("__old"), new.alias("__new"))
    each = items.select(*keys, "item", F.posexplode_outer("indexes").alias("__at", "__old")).join(moved, [*keys, "__old"], "left")
    own = F.array_sort(F.collect_list(F.when(F.col("__new").isNotNull(), F.struct("__at", "__new"))))
    return each.groupBy(*keys, "item").agg(F.transform(own, lambda x: x["__new"]).alias("indexes"))


def labels_of(text: str | None, name: str) -> list[str]:
    """Every string in a list called ``name`` anywhere in a JSON text, each once, by length and then value; what is no JSON has none."""

    def once(pairs: list[tuple]) -> dict:
        made = dict(pairs)
        if len(made) < len(pairs):
            raise ValueError("a name stands twice")
        return made

    def refused(constant: str) -> None:
        raise ValueError(constant)

    try:
        rest = [json_.loads(text or "", object_pairs_hook=once, parse_constant=refused)]
    except (ValueError, RecursionError):
        return []
    found = set()
    while rest:
        value = rest.pop()
        for key, inner in value.items() if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []:
            if key == name and isinstance(inner, list):
                found |= {x.encode("utf-8", "replace").decode() for x in inner if isinstance(x, str)}
            elif isinstance(inner, (dict, list)):
                rest.append(inner)
    return sorted(found, key=lambda x: (len(x), x))


def cited(json: str | Column, name: str = "evidence_ids") -> Column:
    """The labels of :func:`labels_of` as a list; of the texts of a batch only the distinct ones are read."""

    @F.arrow_udf("array<string>")
    def labels(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        told = pa.array([*(labels_of(t, name) for t in coded.dictionary.to_pylist()), []], pa.list_(pa.string()))
        return told.take(coded.indices.fill_null(len(told) - 1))

    return labels(json)


def cited_labels(results: DataFrame, *keys: str, json: str = "result", name: str = "evidence_ids") -> DataFrame:
    """``(*keys, labels)``: every string in a list called ``name`` anywhere in a JSON text, each once, by length and then value.

    What is no JSON, or null, has no labels. ``keys`` name a row.
    """
    return results.select(*keys, cited(json, name).alias("labels"))


def listed(df: DataFrame, name: str, by: str, *keys: str) -> DataFrame:
    """``(*keys, name)``: all other columns of ``df`` as one list for each key, in order of ``by``, a place that no two rows of a key share."""
    own = [c for c in df.columns if c not in (*keys, by)]
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("__by"), F.struct(*own).alias("__row"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["__row"]).alias(name))


def review_results(reviews: DataFrame, risks: DataFrame, rules: DataFrame, points: DataFrame, checklist: DataFrame, reviewed: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, result)``: the stored result of each of ``reviews`` (*keys, overview, partial, changed_files, omitted), as JSON.

    ``risks`` (*keys, position, severity, title) are the model's, ``rules`` (*keys, position, title, path) count as high and come
    after them; they are numbered R1, R2, ... by severity and then position. ``points`` (*keys, position, area, text) are grouped by
    area, areas in order of their first point. ``checklist`` (*keys, position, text, paths, risk_indexes) keeps the names of
    ``reviewed`` files (*keys, name, path), as their paths, and the identifiers of the risks at its positions, each once; an
    item with neither is left out, and counted as omitted. A review has a bounded number of each.
    """
    model = risks.select(*keys, "position", "severity", "title", F.lit("model").alias("origin"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("turn"))
    rule = rules.select(*keys, "position", F.lit("high").alias("severity"), "title", F.lit("rule").alias("origin"), "path", F.lit(1).alias("turn"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "turn", "position"))
    numbered = model.unionByName(rule).withColumn("number", number).withColumn("id", F.concat(F.lit("R"), F.col("number").cast("string")))
    told = listed(numbered.select(*keys, "number", "id", "severity", "title", "origin", "path"), "risks", "number", *keys)

    grouped = grouped_by_area(points.withColumn("point", F.col("text")), F.col("area"), *keys)
    summary = listed(grouped, "summary", "place", *keys)

    item = [*keys, "position"]
    once = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col("__told").alias("told")))), lambda x: x["told"]).alias(name)
    named = checklist.select(*item, F.posexplode("paths").alias("__at", "name")).join(reviewed.select(*keys, "name", F.col("path").alias("__told")), [*keys, "name"])
    paths = named.groupBy(*item, "__told").agg(F.min("__at").alias("__at")).groupBy(*item).agg(once("kept_paths"))
    at = checklist.select(*item, F.posexplode("risk_indexes").alias("__at", "__index"))
    meant = at.join(numbered.where("turn = 0").select(*keys, F.col("position").alias("__index"), F.col("id").alias("__told")), [*keys, "__index"])
    ids = meant.groupBy(*item, "__told").agg(F.min("__at").alias("__at")).groupBy(*item).agg(once("risk_ids"))
    empty = F.array().cast("array<string>")
    items = checklist.select(*item, "text").join(paths, item, "left").join(ids, item, "left").select(*item, "text", F.coalesce("kept_paths", empty).alias("paths"), F.coalesce("risk_ids", empty).alias("risk_ids"))
    judged = items.withColumn("stays", (F.size("paths") > 0) | (F.size("risk_ids") > 0))
    dropped = judged.groupBy(*keys).agg(F.count_if(~F.col("stays")).alias("__dropped"))
    kept = listed(judged.where("stays").drop("stays"), "checklist", "position", *keys)

    files = reviewed.groupBy(*keys).agg(F.count_distinct("path").alias("__files"))
    joined = reviews
    for part in (told, summary, kept, dropped, files):
        joined = joined.join(part, list(keys), "left")
    whole = F.struct(
        F.struct(F.coalesce(F.get("risks", F.lit(0))["severity"], F.lit("none")).alias("level"), F.col("partial")).alias("overall_risk"), "overview",
        *(F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("summary", "risks", "checklist")),
        F.struct("changed_files", F.coalesce("__files", F.lit(0)).alias("reviewed_files")).alias("coverage"), (F.col("omitted") + F.coalesce("__dropped", F.lit(0))).alias("omitted_items"),
    )
    return joined.select(*keys, F.to_json(whole, {"ignoreNullFields": "false"}).alias("result"))
