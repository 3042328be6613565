"""Retrieval operators: search by text, path and terms, nearest vectors, rank fusion, ranges and evidence.

Many questions run in one job: wherever a question takes part, rows are keyed by its id.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.trigrams import candidates

RRF_K = 60
EVIDENCE_ITEMS, EVIDENCE_TOKENS, ITEM_TOKENS = 12, 16_000, 4_000
CHUNK_LINES, CHUNK_OVERLAP = 60, 10
SYMBOL_SPAN = 120
MAX_TERMS = 64


def in_snapshot(files: DataFrame, snapshot: str) -> DataFrame:
    """The files of one snapshot: what each search of contents reads."""
    return files.where(F.col("snapshot_id") == snapshot)


def line_search(files: DataFrame, query: str, limit: int) -> DataFrame:
    """``(path, line, snippet)`` of the first ``limit`` lines, by path and line, that contain ``query``.

    Files are tested whole before their lines are made; a query with a line feed matches no line.
    """
    some = files.where(X.contains_folded("content", query)).select("path", F.posexplode(X.lines("content")).alias("at", "text"))
    found = some.where(X.contains_folded("text", query))
    where = F.instr(F.lower("text"), query.lower()) - 1
    return found.orderBy("path", "at").limit(limit).select("path", (F.col("at") + 1).alias("line"), X.line_snippet(F.col("text"), where).alias("snippet"))


WORD_SIMILARITY = 0.6


def similar(name: str, query: str, least: float) -> tuple[Column, Column]:
    """Whether ``name`` resembles ``query``, as a whole or in a stretch of it, and the greater of the two scores."""
    whole, part = X.similarity(X.trigrams(name), X.trigrams(F.lit(query))), X.word_similarity(query, name, WORD_SIMILARITY)
    return (whole >= least) | (part >= WORD_SIMILARITY), F.round(F.greatest(whole, part), 9)


def path_search(files: DataFrame, query: str, limit: int, least_similarity: float = 0.3, index: DataFrame | None = None) -> DataFrame:
    """``(path, tier, similarity, start_line, end_line)``: exact path or name first, then substrings, then similar paths; all of the file's lines.

    ``index`` is a trigram index of the paths; with it only paths that may match are looked at.
    """
    some = candidates(index, query, least_similarity) if index is not None else None
    paths = files.select("path") if some is None else some.select(F.col("key").alias("path"))
    name = X.basename("path")
    alike, score = similar("path", query, least_similarity)
    tier = F.when((F.col("path") == query) | (name == query), 0).when(X.contains_folded("path", query), 1).otherwise(2)
    scored = paths.select("path", tier.alias("tier"), score.alias("similarity"), alike.alias("alike"))
    ranked = scored.where((F.col("tier") < 2) | F.col("alike")).drop("alike").orderBy("tier", F.desc("similarity"), F.length("path"), "path").limit(limit)
    # at most `limit` rows read content
    content = files.select("path", F.greatest(X.line_count("content"), F.lit(1)).alias("end_line"))
    return content.join(F.broadcast(ranked), "path").select("path", "tier", "similarity", F.lit(1).alias("start_line"), "end_line")


def declared_symbols(files: DataFrame, pattern: str = r"[\p{Lu}][\p{L}]{5,}") -> DataFrame:
    """``(path, name, line)``: the first line of each name that ``pattern`` finds, as a stand-in for declarations."""
    each = files.select("path", F.posexplode(X.lines("content")).alias("at", "text"))
    names = each.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("name"))
    return names.groupBy("path", "name").agg(F.min("line").alias("line"))


def symbol_search(symbols: DataFrame, files: DataFrame, query: str, limit: int, least_similarity: float = 0.3, index: DataFrame | None = None) -> DataFrame:
    """``(path, name, qualified_name, kind, start_line, end_line, tier, similarity, excerpt)`` of declarations, by name or qualified name.

    Symbols are ranked first; only the ranked ones read content, three lines of their own at most. Resemblance is that of the plain name.
    ``index`` is a trigram index of the qualified names; with it only symbols that may match are looked at.
    """
    some = candidates(index, query, least_similarity, whole_texts=False) if index is not None else None
    symbols = symbols if some is None else symbols.join(some, symbols.qualified_name == some.key, "left_semi")
    alike, score = similar("name", query, least_similarity)
    either = lambda test: test(F.col("name")) | test(F.col("qualified_name"))
    tier = F.when(either(lambda c: c == query), 0).when(either(lambda c: X.contains_folded(c, query)), 1).otherwise(2)
    own = ("path", "name", "qualified_name", "kind", "start_line", "end_line")
    scored = symbols.select(*own, tier.alias("tier"), score.alias("similarity"), alike.alias("alike"))
    ranked = scored.where((F.col("tier") < 2) | F.col("alike")).drop("alike").orderBy("tier", F.desc("similarity"), F.length("name"), "path", "start_line", "qualified_name").limit(limit)
    # at most `limit` rows
    content = files.select("path", "content").join(F.broadcast(ranked), "path")
    excerpt = F.array_join(F.slice(X.lines("content"), F.col("start_line"), F.least(F.lit(X.SNIPPET_LINES), F.col("end_line") - F.col("start_line") + 1)), "\n")
    return content.select(*own, "tier", "similarity", X.snippet(excerpt).alias("excerpt"))


def window_chunks(files: DataFrame, size: int = CHUNK_LINES, overlap: int = CHUNK_OVERLAP, *keys: str) -> DataFrame:
    """``(*keys, start_line, end_line, text)``: windows of lines; the last ends with the file, an empty file has none."""
    step = size - overlap
    with_lines = files.select(*keys, X.lines("content").alias("l"))
    n = F.size("l")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.lit(1) + F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int") * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = with_lines.select(*keys, "l", F.explode(starts).alias("start_line"))
    end = F.least(F.col("start_line") + size - 1, n)
    return each.select(*keys, "start_line", end.alias("end_line"), F.array_join(F.slice("l", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("text"))


def postings(chunks: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``(*keys, term, pos)``: the inverted list of identifier terms."""
    return chunks.select(*keys, F.posexplode(X.split_identifiers(text)).alias("pos", "term"))


def query_terms(questions: DataFrame, question: str = "question", key: str = "question_id") -> DataFrame:
    """``(key, term, prefix)``: distinct terms of each question without stop words; stems match as prefixes."""
    dropped = [*X.STOP_WORDS, *X.CODE_KEYWORDS]
    words = F.filter(F.array_distinct(X.split_identifiers(X.separate_scripts(question))), lambda t: (F.length(t) >= 2) & ~t.isin(dropped))

    def stemmed(t: Column) -> Column:
        whole = F.struct(t.alias("term"), F.lit(False).alias("prefix"))
        for suffix in reversed(X.SUFFIXES):  # the first suffix that holds is the outermost test
            cut = F.struct(t.substr(F.lit(1), F.length(t) - len(suffix)).alias("term"), F.lit(True).alias("prefix"))
            whole = F.when(F.endswith(t, F.lit(suffix)) & (F.length(t) - len(suffix) >= X.LEAST_STEM), cut).otherwise(whole)
        return whole

    kept = F.slice(F.array_distinct(F.transform(words, stemmed)), 1, MAX_TERMS)
    return questions.select(key, F.explode(kept).alias("t")).select(key, "t.term", "t.prefix")


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector is null, zero, or holds a null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - F.try_divide(dot, norm(a) * norm(b))


def exact_nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``(vec_id, distance)`` of the ``k`` nearest by cosine, ties to the smaller id; vectors without a distance take no part."""
    distance = cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select("vec_id", distance.alias("distance")).where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", "vec_id").limit(k)


def reciprocal_rank_fusion(ranked: DataFrame, *keys: str, item: str = "item", k: int = RRF_K) -> DataFrame:
    """``(*keys, item, score, place)`` from rows ``(*keys, list_no, rank, item)``.

    Repeats inside a list count once, at their best rank. Ties go to the item that comes first, list by list.
    """
    best = ranked.groupBy(*keys, item, "list_no").agg(F.min("rank").alias("rank"))
    # scores are summed list by list, so that the sum's rounding doesn't depend on the order of rows
    per = best.groupBy(*keys, item).agg(F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("at"))
    score = F.aggregate("at", F.lit(0.0), lambda s, x: s + 1 / (k + x["rank"]))
    scored = per.select(*keys, item, F.round(score, 12).alias("score"), F.col("at")[0].alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "first") if keys else Window.orderBy(F.desc("score"), "first")
    return scored.select(*keys, item, "score", F.row_number().over(order).alias("place"))


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, start_line, end_line, place)``: overlapping or adjacent ranges of a key joined, at the best place."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("new", F.coalesce(F.col("start_line") > reach + 1, F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("place").alias("place")).drop("island")


def capped_spans(ranges: DataFrame, span: int = SYMBOL_SPAN) -> DataFrame:
    """Symbols' ranges cut to ``span`` lines; others stay."""
    end = F.when(F.col("source_type") == "symbol", F.least("end_line", F.col("start_line") + (span - 1))).otherwise(F.col("end_line"))
    return ranges.withColumn("end_line", end)


def take_evidence(items: Iterable[tuple[int, list[str]]], tokens: float = EVIDENCE_TOKENS, most: int = EVIDENCE_ITEMS, item_tokens: float = ITEM_TOKENS) -> list[tuple[int, int]]:
    """``(position, lines)`` of the items kept: whole lines within the item's and the overall budget.

    An item whose first line doesn't fit is passed over; one that the overall budget cuts ends the list.
    """
    kept, used = [], 0.0
    for position, own in items:
        if len(kept) == most:
            break
        room = min(tokens - used, item_tokens)
        chars, n = -1, 0
        for line in own:
            if (chars + 1 + len(line)) / X.CHARS_PER_TOKEN > room:
                break
            chars, n = chars + 1 + len(line), n + 1
        if not n:
            continue
        cut_overall = n < len(own) and tokens - used <= item_tokens
        used += max(chars, 0) / X.CHARS_PER_TOKEN
        kept.append((position, n))
        if cut_overall:
            break
    return kept


def build_evidence(ranked: DataFrame, files: DataFrame, key: str = "question_id", tokens: float = EVIDENCE_TOKENS, most: int = EVIDENCE_ITEMS, item_tokens: float = ITEM_TOKENS, candidates: int = 60) -> DataFrame:
    """``(key, label, path, start_line, end_line, excerpt_sha256, excerpt)`` from ``(key, place, path, start_line, end_line)``.

    The budget is spent in order of place, one question at a time; a question has ``candidates`` ranges
    at most, as the lists that it is fused from are limited.
    """
    first = ranked.where(F.col("place") <= candidates)
    cut = F.slice(X.lines("content"), F.col("start_line"), F.greatest(F.least("end_line", F.size(X.lines("content"))) - F.col("start_line") + 1, F.lit(0)))
    own = first.join(files.select("path", "content"), "path").where("start_line >= 1").select(key, "place", "path", "start_line", cut.alias("own"))

    def spend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable").reset_index(drop=True)
        kept = take_evidence(((i, list(x)) for i, x in enumerate(pdf.own)), tokens, most, item_tokens)
        rows = [(pdf[key][i], f"E{n}", n, pdf.path[i], int(pdf.start_line[i]), int(pdf.start_line[i]) + k - 1, "\n".join(pdf.own[i][:k])) for n, (i, k) in enumerate(kept, 1)]
        return pd.DataFrame(rows, columns=[key, "label", "rank", "path", "start_line", "end_line", "excerpt"])

    kind = dict(ranked.dtypes)[key]
    made = own.groupBy(key).applyInPandas(spend, f"{key} {kind}, label string, rank int, path string, start_line int, end_line int, excerpt string")
    return made.withColumn("excerpt_sha256", F.sha2("excerpt", 256))


def list_tree(files: DataFrame, folder: str = "") -> DataFrame:
    """``(name, is_directory, language, lines)`` of a folder's entries, folders first."""
    inside = files.where(F.startswith("path", F.lit(folder))).select(F.col("path").substr(F.lit(len(folder) + 1), F.length("path")).alias("rest"), "language", X.line_count("content").alias("n"))
    grouped = inside.groupBy(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name")).agg(F.bool_or(F.contains("rest", F.lit("/"))).alias("is_directory"), F.min("language").alias("language"), F.min("n").alias("lines"))
    only = lambda c: F.when(~F.col("is_directory"), F.col(c)).alias(c)
    return grouped.select("name", "is_directory", only("language"), only("lines"))


def read_lines(files: DataFrame, path: str, start: int, end: int, most: int = 1000) -> DataFrame:
    """``(path, start_line, end_line, text)``: lines of one file, at most ``most`` of them and none past its end.

    A start past the end (line 1 of an empty file excepted) gives no row.
    """
    n = F.size(X.lines("content"))
    last = F.least(F.lit(end), F.lit(start + most - 1), F.greatest(n, F.lit(1)))
    text = F.array_join(F.slice(X.lines("content"), start, F.greatest(last - start + 1, F.lit(0))), "\n")
    return files.where((F.col("path") == path) & (F.lit(start) <= F.greatest(n, F.lit(1)))).select("path", F.lit(start).alias("start_line"), last.alias("end_line"), text.alias("text"))


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> tuple[DataFrame, str | None]:
    """One page in a total order, and the cursor of the next page where one row more is there."""
    import base64

    rows = df.orderBy(*order).offset(offset)
    more = rows.limit(size + 1).count() > size
    cursor = base64.urlsafe_b64encode(f"o:{offset + size}".encode()).decode() if more else None
    return rows.limit(size), cursor


IDENTIFIER = r"[/.]|_|[a-z][A-Z]|[A-Z]{2}[a-z]|[0-9]"
PATH_SPAN = 120


def identifier_tokens(questions: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """``(key, at, token, is_identifier)``: identifiers, and plain words of three letters or more that aren't stop words.

    Hyphens separate words outside paths; of tokens that differ in case only the first stays.
    """
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"^(?:\.?/|-)+", ""), r"[./-]+$", "")
    raw = F.transform(F.regexp_extract_all(X.separate_scripts(question), F.lit(r"(?U)[\w./-]+"), F.lit(0)), clean)
    parts = F.flatten(F.transform(raw, lambda t: F.when(t.rlike("[/.]"), F.array(t)).otherwise(F.transform(F.split(t, "-"), clean))))
    plain = lambda t: (F.length(t) > 2) & ~F.lower(t).isin(X.STOP_WORDS) & t.rlike(r"^[\p{L}\p{N}]+$")
    kept = F.filter(parts, lambda t: t.rlike(r"[\p{L}\p{N}]") & (t.rlike(IDENTIFIER) | plain(t)))
    each = questions.select(key, F.posexplode(kept).alias("at", "token"))
    first = each.groupBy(key, F.lower("token").alias("__low")).agg(F.min(F.struct("at", "token")).alias("t"))
    return first.select(key, "t.at", "t.token", F.col("t.token").rlike(IDENTIFIER).alias("is_identifier"))


def path_forms(files: DataFrame) -> DataFrame:
    """``(path, form, weight)``: what a token may equal: the path, its suffixes with a folder, the name, the name's stem."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("form"), F.lit(0.95).alias("weight")))
    own = F.array(*[F.struct(f.alias("form"), F.lit(w).alias("weight")) for f, w in ((F.col("path"), 1.0), (X.basename("path"), 0.9), (X.stem("path"), 0.8))])
    return files.select("path", F.explode(F.concat(own, F.when(F.size(parts) > 2, suffixes).otherwise(F.array().cast("array<struct<form:string,weight:double>>")))).alias("f")).select("path", "f.form", "f.weight")


def first_of_each(rows: DataFrame, most: int, keys: tuple[str, ...], *order: str | Column) -> DataFrame:
    """The rows of the first ``most`` places of each key, equal rows included; the tasks drop all others before they are dealt."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def exact_candidates(tokens: DataFrame, forms: DataFrame, *units: str, key: str = "question_id", most: int = 20) -> DataFrame:
    """``(key, *units, score, place)``: units of which a form equals a token, best first.

    Another case costs a fifth, a plain word half. Of equal scores of a unit the earliest token counts.

    Each form and then each token keeps its ``most`` first units, which no question needs more of: those before a unit there come before it
    in every question that has the token. So what is joined with the questions grows with their tokens alone.
    """
    known = first_of_each(forms.select(*units, "form", "weight"), most, ("form", "weight"), *units).withColumn("low", F.lower("form"))
    spelled = tokens.select("token", "is_identifier").distinct().withColumn("low", F.lower("token"))
    score = F.col("weight") * F.when(F.col("form") == F.col("token"), 1.0).otherwise(0.8) * F.when(F.col("is_identifier"), 1.0).otherwise(0.5)
    scored = spelled.join(known, "low").groupBy("token", "is_identifier", *units).agg(F.max(F.round(score, 9)).alias("score"))
    met = tokens.select(key, "at", "token", "is_identifier").join(first_of_each(scored, most, ("token", "is_identifier"), F.desc("score"), *units), ["token", "is_identifier"])
    best = met.groupBy(key, *units).agg(F.max(F.struct("score", (-F.col("at")).alias("early"))).alias("b"))
    order = Window.partitionBy(key).orderBy(F.desc("b.score"), F.desc("b.early"), *units)
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, *units, F.col("b.score").alias("score"), "place")


def symbol_first(fused: DataFrame, *keys: str) -> DataFrame:
    """``place`` counted anew: symbols before all else, each in fused order."""
    order = Window.partitionBy(*keys).orderBy(F.col("source_type") != "symbol", "place")
    return fused.withColumn("place", F.row_number().over(order))
