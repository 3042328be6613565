"""Tree operators: what differs between two snapshots, renames, hunks, and what of it is reviewed.

A tree is ``(path, sha256, content)``; sha256 may be null (content unknown).
"""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.ingestion import CREDENTIAL_EXCEPTIONS, CREDENTIAL_NAMES, excluded_folder, glob_pattern
from tessera.operators.ranges import same_lines, with_meets

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
CONTEXT_LINES = 3
MOST_FILES, MOST_LINES, MOST_HUNKS, MOST_TOKENS = 100, 2_000, 80, 40_000


def compare_trees(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(path, change, base_sha256, head_sha256)`` of added, removed and modified paths.

    Two null digests count as unchanged, a null and a digest as modified.
    """
    b = base.select("path", F.col("sha256").alias("base_sha256"), F.lit(True).alias("in_base"))
    h = head.select("path", F.col("sha256").alias("head_sha256"), F.lit(True).alias("in_head"))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(~F.col("base_sha256").eqNullSafe(F.col("head_sha256")), "modified")
    return b.join(h, "path", "full_outer").select("path", change.alias("change"), "base_sha256", "head_sha256").where("change is not null")


def pair_renames(changes: DataFrame, hints: DataFrame) -> DataFrame:
    """``(old, new)``: one-to-one pairs of removed and added paths.

    Hints ``(old, new)`` come first: of the hints of one old path the smallest new one holds. Then paths of
    equal content pair in path order. Empty files never pair.
    """
    added = changes.where("change = 'added'").select(F.col("path").alias("new"), F.col("head_sha256").alias("sha256"))
    removed = changes.where("change = 'removed'").select(F.col("path").alias("old"), F.col("base_sha256").alias("sha256"))
    valid = hints.select("old", "new").distinct().join(added.select("new"), "new").join(removed.select("old"), "old")
    told = valid.groupBy("old").agg(F.min("new").alias("new"))
    rest_new = added.join(told, "new", "left_anti").where(F.col("sha256").isNotNull() & (F.col("sha256") != EMPTY_SHA256))
    rest_old = removed.join(told, "old", "left_anti").where(F.col("sha256").isNotNull() & (F.col("sha256") != EMPTY_SHA256))
    numbered = lambda df, c: df.withColumn("n", F.row_number().over(Window.partitionBy("sha256").orderBy(c)))
    return told.select("old", "new").unionByName(numbered(rest_old, "old").join(numbered(rest_new, "new"), ["sha256", "n"]).select("old", "new"))


def is_credential(path: Column) -> Column:
    name = F.lower(X.basename(path))
    return name.rlike(glob_pattern(*CREDENTIAL_NAMES)) & ~name.isin(*CREDENTIAL_EXCEPTIONS)


def tainted_paths(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(path)``: credential paths and the paths paired with one; their content is withheld."""
    own = changes.where(is_credential(F.col("path"))).select("path")
    by_new = pairs.where(is_credential(F.col("old")) | is_credential(F.col("new")))
    return own.unionByName(by_new.select(F.col("old").alias("path"))).unionByName(by_new.select(F.col("new").alias("path"))).distinct()


def changed_entries(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(path, change, old_path, files)``: renames as one entry, changes below an excluded folder as one per folder."""
    renamed = changes.join(pairs.select(F.col("new").alias("path"), F.col("old").alias("old_path")), "path", "left")
    gone = pairs.select(F.col("old").alias("path"))
    kept = renamed.join(gone, "path", "left_anti").withColumn("change", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change")))
    folder = excluded_folder(F.col("path"))
    own = kept.where(folder.isNull()).select("path", "change", "old_path", F.lit(1).cast("long").alias("files"))
    grouped = kept.where(folder.isNotNull()).groupBy(folder.alias("path")).agg(F.when(F.min("change") == F.max("change"), F.min("change")).otherwise("modified").alias("change"), F.count(F.lit(1)).alias("files"))
    return own.unionByName(grouped.select("path", "change", F.lit(None).cast("string").alias("old_path"), "files"))


def diff_lines(before: str, after: str) -> list[tuple[str, int | None, int | None, str]]:
    """``(sign, number before, number after, line)`` of both texts' lines: removed ones, then added ones, of each change."""
    old, new = (t.removesuffix("\n").split("\n") if t else [] for t in (before, after))
    rows: list[tuple[str, int | None, int | None, str]] = []
    p = q = 0
    # the matching blocks end with an empty one behind both texts
    for block in difflib.SequenceMatcher(None, old, new).get_matching_blocks():
        rows += [("-", i + 1, None, old[i]) for i in range(p, block.a)] + [("+", None, j + 1, new[j]) for j in range(q, block.b)]
        rows += [(" ", block.a + i + 1, block.b + i + 1, old[block.a + i]) for i in range(block.size)]
        p, q = block.a + block.size, block.b + block.size
    return rows


def hunks_of(before: str, after: str, context: int = CONTEXT_LINES) -> list[tuple]:
    """``(before_start, before_end, after_start, after_end, removed, added, text)``; an empty side's range is null.

    A hunk is a stretch of lines that are changed, or within ``context`` lines of a change.
    """
    rows = diff_lines(before, after)
    near = sorted({i for at, row in enumerate(rows) if row[0] != " " for i in range(max(0, at - context), min(len(rows), at + context + 1))})
    out = []
    # neighbours have the same difference of line and place among the lines that are kept
    for _, own in groupby(enumerate(near), lambda x: x[1] - x[0]):
        hunk = [rows[i] for _, i in own]
        numbers = [[n for n in side if n is not None] for side in ([r[1] for r in hunk], [r[2] for r in hunk])]
        ends = [f(side) if side else None for side in numbers for f in (min, max)]
        signs = [r[0] for r in hunk]
        out.append((*ends, signs.count("-"), signs.count("+"), "\n".join(sign + line for sign, _, _, line in hunk)))
    return out


HUNKS = "path string, hunk int, before_start int, before_end int, after_start int, after_end int, removed int, added int, text string"


def hunks(changed: DataFrame) -> DataFrame:
    """Hunks of rows ``(path, before, after)``; a null side counts as empty."""
    names = [f.split()[0] for f in HUNKS.split(", ")]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, i, *h) for path, a, b in zip(pdf.path, pdf.before, pdf.after, strict=True) for i, h in enumerate(hunks_of(a or "", b or ""))]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({n: "Int32" for n in names[1:-1]})

    return changed.select("path", "before", "after").mapInPandas(make, HUNKS)


def diff_sizes(made: DataFrame) -> DataFrame:
    """``(path, hunks, additions, deletions, tokens)`` of each file's hunks."""
    tokens = F.sum(F.length("text") + 1) / X.CHARS_PER_TOKEN
    return made.groupBy("path").agg(F.count(F.lit(1)).alias("hunks"), F.sum("added").alias("additions"), F.sum("removed").alias("deletions"), tokens.alias("tokens"))


def review_rank(path: Column) -> Column:
    """Source 0, tests 1, documentation 2."""
    return F.when(F.lower(path).rlike(r"\.(md|mdx|txt)$"), 2).when(X.is_test_path(path), 1).otherwise(0)


def select_within(rows: DataFrame, limits: dict[str, float], *keys: str, order: str = "place") -> DataFrame:
    """Rows taken in order while all limits hold; one that doesn't fit is passed over, and later ones may still fit.

    A group's rows stream past in order: a task holds what one group has used, however many rows it has. Of rows with an equal ``order`` the hash of their columns decides.
    """
    columns, names = list(limits), rows.columns

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, dict.fromkeys(columns, 0.0)
        for batch in batches:
            groups = zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True) if keys else ((),) * batch.num_rows
            kept = []
            for group, row in zip(groups, zip(*(batch.column(names.index(c)).to_pylist() for c in columns), strict=True), strict=True):
                if group != now:
                    now, used = group, dict.fromkeys(columns, 0.0)
                fits = all(used[c] + v <= limits[c] for c, v in zip(columns, row, strict=True))
                kept.append(fits)
                if fits:
                    for c, v in zip(columns, row, strict=True):
                        used[c] += v
            yield batch.filter(pa.array(kept, pa.bool_()))

    dealt = rows.repartition(*keys) if keys else rows.coalesce(1)
    return dealt.sortWithinPartitions(*keys, order, F.xxhash64(*names)).mapInArrow(take, rows.schema)


def longest_prefix(rows: DataFrame, tokens: float, most: int, *keys: str, order: str = "place") -> DataFrame:
    """Rows of each group up to where the tokens or the count run over: what is cut is the tail."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("used") <= tokens) & (F.col("n") <= most)).drop("used", "n")


def related_files(files: DataFrame, names: DataFrame, most: int, *keys: str) -> DataFrame:
    """``(*keys, path, names, place)``: files that hold most of the names ``(*keys, path, name)`` as whole words.

    ``path`` of a name is where it is declared; that file isn't related to itself.
    """
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    asked = names.select(*keys, F.col("path").alias("own"), "name")
    hits = words.join(asked, "name").where("path <> own").groupBy(*keys, "path").agg(F.count_distinct("name").alias("names"))
    order = Window.partitionBy(*keys).orderBy(F.desc("names"), "path")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def holding_changed_lines(declared: DataFrame, lines: DataFrame) -> DataFrame:
    """Declarations ``(path, start_line, end_line, ...)`` that hold a changed line ``(path, line)``."""
    return with_meets(declared, lines.select("path", *same_lines("line")), "__held", "path").where("__held").drop("__held")


def overlay(files: DataFrame, renames: DataFrame, edits: DataFrame, adds: DataFrame, removes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, content)`` after renames ``(old, new)``, edits ``(path, position, find, replace)``, adds ``(path, content)`` and
    removes ``(path)``, in that order; and the ``(step, path, fault)`` of those that can't be done, which change nothing.

    A file's edits are folded over its text in order of position: what an edit looks for must stand exactly once in what
    the edits before it made. A rename needs a file, one for each old path, and a new path that no other file has or gets
    (of several the first old path in order holds); one that needs another rename first isn't done. What is added
    must not be there, what is removed must.
    """
    here = files.select("path", F.lit(True).alias("__here"))
    turn = F.row_number().over(Window.partitionBy("new").orderBy("old"))
    own = renames.groupBy("old").agg(F.min("new").alias("new")).withColumn("__turn", turn)
    asked = own.join(here.withColumnRenamed("path", "old"), "old", "left").join(here.select(F.col("path").alias("new"), F.col("__here").alias("__taken")), "new", "left")
    judged = asked.withColumn("fault", F.when(F.col("__here").isNull(), "no such file").when(F.col("__taken") | (F.col("__turn") > 1), "already exists"))
    fault = lambda df, step, path: df.where("fault is not null").select(F.lit(step).alias("step"), F.col(path).alias("path"), "fault")
    moved = files.select("path", "content").join(judged.where("fault is null").select(F.col("old").alias("path"), "new"), "path", "left").select(F.coalesce("new", "path").alias("path"), "content")

    listed = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "find", "replace"))).alias("__edits"))
    joined = moved.withColumn("__here", F.lit(True)).join(listed, "path", "full_outer")

    def step(state: Column, e: Column) -> Column:
        text = state["text"]
        times = F.when(e["find"] == "", F.lit(0)).otherwise((F.length(text) - F.length(F.replace(text, e["find"], F.lit("")))) / F.length(e["find"])).cast("int")
        made = F.struct(F.replace(text, e["find"], e["replace"]).alias("text"), state["faults"].alias("faults"))
        told = F.concat(state["faults"], F.array(F.concat(F.lit("edit "), e["position"].cast("string"), F.lit(" matches "), times.cast("string"), F.lit(" times"))))
        return F.when(times == 1, made).otherwise(F.struct(text.alias("text"), told.alias("faults")))

    start = F.struct(F.coalesce("content", F.lit("")).alias("text"), F.array().cast("array<string>").alias("faults"))
    folded = joined.withColumn("__made", F.when(F.col("__edits").isNotNull() & F.col("__here"), F.aggregate("__edits", start, step)))
    edited = folded.where("__here").select("path", F.when(F.size("__made.faults") < F.size("__edits"), F.col("__made.text")).otherwise(F.col("content")).alias("content"))
    bad_edits = folded.where("__here").select("path", F.explode("__made.faults").alias("fault")).unionByName(folded.where("__here is null").select("path", F.lit("no such file").alias("fault")))

    there = edited.select("path", F.lit(True).alias("__there"))
    added = adds.join(there, "path", "left").withColumn("fault", F.when(F.col("__there"), "already exists"))
    all_ = edited.unionByName(added.where("fault is null").select("path", "content"))
    gone = removes.select("path").distinct().join(all_.select("path", F.lit(True).alias("__there")), "path", "left").withColumn("fault", F.when(F.col("__there").isNull(), "no such file"))
    faults = fault(judged, "rename", "old").unionByName(fault(bad_edits, "edit", "path")).unionByName(fault(added, "add", "path")).unionByName(fault(gone, "remove", "path"))
    return all_.join(gone.where("fault is null"), "path", "left_anti"), faults


def candidate_tests(files: DataFrame, changed: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """``(path, reason, names, place)``: unchanged tests that hold changed names (most names first), then tests named after a changed file."""
    tests = files.join(changed.select("path"), "path", "left_anti").where(X.is_test_path("path"))
    words = tests.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    holding = words.join(names.select("name").distinct(), "name").groupBy("path").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("first"))
    subject = F.regexp_extract(X.basename("path"), r"^(?:test_)?(.+?)(?:_test|\.test|\.spec)?\.[^.]*$", 1)
    subjects = changed.where(~X.is_test_path("path")).groupBy(X.stem("path").alias("subject")).agg(F.min("path").alias("of"))
    named = tests.join(holding, "path", "left_anti").withColumn("subject", subject).join(subjects, "subject")
    both = holding.select("path", F.concat(F.lit("refers to "), "first").alias("reason"), "names").unionByName(named.select("path", F.concat(F.lit("named after "), "of").alias("reason"), F.lit(0).cast("long").alias("names")))
    ranked = both.orderBy(F.desc("names"), "path").limit(most)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("names"), "path")))


def build_decisions(requests: DataFrame, snapshots: DataFrame, failures: DataFrame) -> DataFrame:
    """``decision`` of each request (repository_id, commit, version): reuse a ready snapshot, skip a commit that can't be built, or build."""
    unit = ["repository_id", "commit", "version"]
    ready = snapshots.where("status = 'ready'").select(*unit).distinct().withColumn("ready", F.lit(True))
    failed = failures.where("permanent AND error <> 'access'").select("repository_id", "commit").distinct().withColumn("failed", F.lit(True))
    joined = requests.join(ready, unit, "left").join(failed, ["repository_id", "commit"], "left")
    return joined.withColumn("decision", F.when(F.col("ready"), "reuse").when(F.col("failed"), "skip").otherwise("build")).drop("ready", "failed")


# fixed values: names that tell nothing of a change, and the sizes of what is kept
COMMON_NAMES = ("main", "init", "__init__", "get", "set", "run", "test")
LEAST_NAME, MOST_NAMES = 4, 30
AROUND, MATCHES, EXCERPT_LINES = 6, 2, 40
MOST_LABELS = 200


def useful_names(names: DataFrame, *keys: str, most: int = MOST_NAMES) -> DataFrame:
    """``(*keys, name, place)``: distinct names of ``(*keys, position, name)`` by first position, without short and common ones."""
    telling = names.where((F.length("name") >= LEAST_NAME) & ~F.lower("name").isin(*COMMON_NAMES))
    first = telling.groupBy(*keys, "name").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position", "name"))
    return first.select(*keys, "name", place.alias("place")).where(F.col("place") <= most)


def excerpts(chosen: DataFrame, files: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, path, start_line, end_line, excerpt)`` of the files ``(*keys, path)``.

    It reaches from ``AROUND`` lines before the first line that holds one of ``names`` (*keys, name) as a word to as many
    after the second such line; a file without one gives its first lines, an empty file nothing.
    """
    own = chosen.select(*keys, "path").join(files.select("path", X.lines("content").alias("__lines")), "path")
    each = own.select(*keys, "path", F.posexplode("__lines").alias("__at", "__line"))
    words = each.select(*keys, "path", (F.col("__at") + 1).alias("__n"), F.explode(F.array_distinct(F.regexp_extract_all("__line", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("name"))
    asked = names.select(*keys, "name").distinct()
    met = words.join(asked, [*keys, "name"], "left_semi").select(*keys, "path", "__n").distinct()
    order = Window.partitionBy(*keys, "path").orderBy("__n")
    two = met.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= MATCHES).groupBy(*keys, "path").agg(F.min("__n").alias("__first"), F.max("__n").alias("__second"))
    size = F.size("__lines")
    start = F.coalesce(F.greatest(F.lit(1), F.col("__first") - AROUND), F.lit(1))
    end = F.when(F.col("__first").isNull(), F.least(size, F.lit(1 + 2 * AROUND))).otherwise(F.least(size, F.col("__second") + AROUND, F.col("start_line") + EXCERPT_LINES - 1))
    placed = own.join(two, [*keys, "path"], "left").where(size > 0).withColumn("start_line", start).withColumn("end_line", end)
    return placed.select(*keys, "path", "start_line", "end_line", F.array_join(F.slice("__lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("excerpt"))


def labelled_evidence(made: DataFrame, context: DataFrame, tokens: float, *keys: str, most: int = MOST_LABELS) -> DataFrame:
    """``(*keys, label, rank, source_type, side, path, start_line, end_line)`` of a review.

    ``made`` are hunks with their ``tokens``: by path and hunk, the lines after the change and then those before it; none is
    left out. Then ``context`` (*keys, place, source_type, path, start_line, end_line, tokens) in order of place, of which
    the tail goes that the budget or ``most`` labels leave no room for.
    """
    after = F.struct(F.lit("after").alias("side"), F.col("after_start").alias("start_line"), F.col("after_end").alias("end_line"), (F.col("added") > 0).alias("stands"))
    before = F.struct(F.lit("before").alias("side"), F.col("before_start").alias("start_line"), F.col("before_end").alias("end_line"), (F.col("removed") > 0).alias("stands"))
    sides = F.filter(F.array(after, before), lambda s: s.stands & s.start_line.isNotNull())
    each = made.select(*keys, "path", "hunk", F.posexplode(sides).alias("__turn", "__side"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "hunk", "__turn"))
    change = each.select(*keys, rank.alias("rank"), F.lit("change").alias("source_type"), "__side.side", "path", "__side.start_line", "__side.end_line")
    taken = made.groupBy(*keys).agg(F.sum("tokens").alias("__diff"), F.sum(F.size(sides)).alias("__items"))
    order = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = context.withColumn("__used", F.sum("tokens").over(order)).withColumn("__n", F.count(F.lit(1)).over(order)).join(taken, list(keys), "left")
    items = F.coalesce("__items", F.lit(0))
    fits = (F.col("__used") <= tokens - F.coalesce("__diff", F.lit(0.0))) & (F.col("__n") + items <= most)
    rest = running.where(fits).select(*keys, (F.col("__n") + items).cast("int").alias("rank"), "source_type", F.lit("after").alias("side"), "path", "start_line", "end_line")
    return change.unionByName(rest).withColumn("label", F.concat(F.lit("E"), F.col("rank").cast("string")))
