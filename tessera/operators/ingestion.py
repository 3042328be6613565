"""Ingestion operators: which files count, why others don't, and what is made of their texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.declared import python_declarations, script_declarations

# fixed values: folders, names and marks by which files are left out
EXCLUDED_FOLDERS = (".git", "node_modules", "vendor", ".venv", "venv", "site-packages", "__pycache__", "dist", "build", ".next", "coverage")
CREDENTIAL_NAMES = (".env*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*", "credentials*.json", ".netrc", ".npmrc", ".pypirc")
CREDENTIAL_EXCEPTIONS = (".env.example",)
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "uv.lock", "Pipfile.lock", "pdm.lock",
    "Cargo.lock", "Gemfile.lock", "composer.lock", "go.sum", "mix.lock", "pubspec.lock", "Podfile.lock", "flake.lock",
)
GENERATED_NAMES = ("*.min.js", "*.min.css", "*.map")
GENERATED_MARKS = ("@generated", "DO NOT EDIT")
MARK_LINES = 5
MOST_FILES, MOST_BYTES, MOST_LINES = 5_000, 100 * 2**20, 100_000
SECTION_CHARS = 1600


def glob_pattern(*globs: str) -> str:
    """A regular expression for names that match one of the globs (``*`` and ``?``)."""
    each = (re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs)
    return f"^({'|'.join(each)})$"


def excluded_folder(path: Column) -> Column:
    """The outermost folder of a path that is left out; null for none."""
    parts = F.split(path, "/")
    first = F.array_min(F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.when(x.isin(*EXCLUDED_FOLDERS), i)), lambda i: i.isNotNull()))
    return F.when(first.isNotNull(), F.array_join(F.slice(parts, 1, first + 1), "/"))


def unsafe_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return (path == "") | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\0")) | F.array_contains(parts, "..")


def skip_reason(path: Column, content: Column, kind: Column) -> Column:
    """Why a file doesn't count; null where it does. The first rule that holds names the reason.

    Members that are neither files nor links are unsafe. A null content is that of a file above the size limit;
    a content that is no valid UTF-8 is told by its encoding.
    """
    name = X.basename(path)
    lower = F.lower(name)
    head = F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, MARK_LINES), "\n")
    marked = F.lit(False)
    for mark in GENERATED_MARKS:
        marked = marked | F.contains(head, F.lit(mark))
    return (
        F.when(unsafe_path(path), "unsafe_path")
        .when(kind == "link", "link")
        .when(kind != "file", "unsafe_path")
        .when(excluded_folder(path).isNotNull(), "excluded_directory")
        .when(lower.rlike(glob_pattern(*CREDENTIAL_NAMES)) & ~lower.isin(*CREDENTIAL_EXCEPTIONS), "credential_file")
        .when(name.isin(*LOCKFILES) | lower.rlike(glob_pattern(*GENERATED_NAMES)) | marked, "generated")
        .when(content.isNull(), "too_large")
        .when(F.contains(content, F.lit("\0")), "binary")
        .when(~F.is_valid_utf8(content), "encoding")
    )


def classify(members: DataFrame) -> DataFrame:
    """``members`` (path, kind, content) with ``reason``; of repeated paths all but the first by ``member_no`` are unsafe."""
    order = Window.partitionBy("path").orderBy("member_no")
    again = F.row_number().over(order) > 1
    return members.withColumn("reason", F.when(again, "unsafe_path").otherwise(skip_reason(F.col("path"), F.col("content"), F.col("kind"))))


def coverage_entries(classified: DataFrame) -> DataFrame:
    """``(path, entry_type, reason)``: one entry for each file left out, and one for each folder left out."""
    folder = excluded_folder(F.col("path"))
    inside = F.col("reason") == "excluded_directory"
    return classified.where("reason is not null").select(F.when(inside, folder).otherwise(F.col("path")).alias("path"), F.when(inside, "directory").otherwise("file").alias("entry_type"), "reason").distinct()


def coverage_summary(classified: DataFrame) -> DataFrame:
    """Files, lines and bytes that count, and how many entries don't."""
    good = classified.where("reason is null").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(X.line_count("content")), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    left_out = coverage_entries(classified).agg(F.count(F.lit(1)).alias("skipped"))
    return good.crossJoin(left_out)  # one row each


def exceeded_limit(summary: DataFrame) -> DataFrame:
    """The first limit that a snapshot exceeds, in the order files, bytes, lines; null for none."""
    return summary.select("*", F.when(F.col("files") > MOST_FILES, "files").when(F.col("bytes") > MOST_BYTES, "bytes").when(F.col("lines") > MOST_LINES, "lines").alias("exceeded"))


def archive_limits(members: DataFrame, most: int, most_bytes: int, *keys: str) -> DataFrame:
    """The first member of each archive at which its count or running size exceeds a limit."""
    order = Window.partitionBy(*keys).orderBy("member_no")
    running = members.select(*keys, "member_no", F.row_number().over(order).alias("n"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    over = running.where((F.col("n") > most) | (F.col("bytes") > most_bytes))
    return over.groupBy(*keys).agg(F.min("member_no").alias("member_no"))


def attribute_rules(attributes: DataFrame) -> DataFrame:
    """``(rule_no, regex, generated)`` from lines ``(line_no, line)`` of pattern and attribute fields."""
    fields = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    known = attributes.select("line_no", fields.alias("f")).where((F.size("f") > 1) & ~F.startswith(F.col("f")[0], F.lit("#")) & ~F.startswith(F.col("f")[0], F.lit("[attr]")) & ~F.endswith(F.col("f")[0], F.lit("/")))
    each = known.select("line_no", F.col("f")[0].alias("pattern"), F.posexplode(F.slice("f", 2, F.size("f"))).alias("at", "attr"))
    told = F.when(F.col("attr").isin("linguist-generated", "linguist-generated=true"), True).when(F.col("attr").isin("-linguist-generated", "!linguist-generated") | F.startswith("attr", F.lit("linguist-generated=")), False)
    # a pattern without a slash is matched against names, others from the root; ** spans folders
    bare = ~F.contains("pattern", F.lit("/"))
    body = F.regexp_replace(F.regexp_replace("pattern", r"^/", ""), r"([.+^$(){}|\\\[\]])", r"\\$1")
    body = F.replace(F.replace(F.replace(body, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    body = F.replace(F.replace(F.replace(body, F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit("(.*/)?")), F.lit("\x02"), F.lit(".*"))
    regex = F.concat(F.when(bare, "(^|/)").otherwise("^"), body, F.lit("$"))
    order = F.col("line_no") * 1000 + F.col("at")
    return each.where(told.isNotNull()).select(order.alias("rule_no"), regex.alias("regex"), told.alias("generated"))


def marked_generated(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """``files`` with ``generated`` by ordered rules ``(regex, generated)`` of one attributes file: the last match wins.

    Rules in a row that say the same are one pattern."""
    outcomes = [(generated, "|".join(f"(?:{regex})" for regex, _ in own)) for generated, own in groupby(rules, lambda r: r[1])]
    told = [F.when(F.col("path").rlike(pattern), F.lit(generated)) for generated, pattern in reversed(outcomes)]
    return files.withColumn("generated", F.coalesce(*told, F.lit(False)))


def after_attributes(marked: DataFrame) -> DataFrame:
    """``reason`` of classified members once their root attributes are known: ``generated`` ones that were to count, or to be
    left out for their content or size, are generated; other reasons stay."""
    open_ = F.col("reason").isNull() | F.col("reason").isin("too_large", "binary", "encoding")
    return marked.withColumn("reason", F.when(F.col("generated") & open_, "generated").otherwise(F.col("reason")))


FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?$")


def heading_sections(content: str, most: int = SECTION_CHARS) -> list[tuple[int, int, str, str]]:
    """``(start_line, end_line, heading_path, text)`` of a Markdown text's sections.

    Headings within fences are text. Blocks between blank lines are put together up to ``most``
    characters; a longer block is cut between lines. Sections that hold a heading only give nothing.
    """
    rows = content.split("\n")
    if rows[-1] == "":
        rows.pop()
    out: list[tuple[int, int, str, str]] = []
    titles: list[tuple[int, str]] = []
    fence, path, body, blocks, block = "", "", False, [], []  # blocks: lists of line numbers

    def close() -> None:
        nonlocal blocks, block
        if block:
            blocks.append(block)
        if body:
            held: list[int] = []

            def flush() -> None:
                if held and any(rows[i].strip() for i in held):
                    out.append((held[0] + 1, held[-1] + 1, path, "\n".join(rows[held[0] : held[-1] + 1])))
                held.clear()

            size = lambda a, b: sum(len(r) for r in rows[a : b + 1]) + b - a
            for own in blocks:
                if held and size(held[0], own[-1]) > most:
                    flush()
                if held or size(own[0], own[-1]) <= most:
                    held.extend(own)
                    continue
                for i in own:
                    if held and size(held[0], i) > most:
                        flush()
                    held.append(i)
                flush()
            flush()
        blocks, block = [], []

    for i, row in enumerate(rows):
        bare = row.rstrip()
        mark = FENCE.match(bare)
        if fence:
            block.append(i)
            body = True
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not bare[mark.end() :].strip():
                fence = ""
            continue
        if mark:
            fence = mark[1]
        elif heading := HEADING.match(bare):
            close()
            level = len(heading[1])
            titles = [t for t in titles if t[0] < level] + [(level, (heading[2] or "").strip())]
            path, body, block = " > ".join(t for _, t in titles if t), False, [i]
            continue
        if bare.strip():
            block.append(i)
            body = True
        elif block:
            blocks.append(block)
            block = []
    close()
    return out


def heading_chunks(files: DataFrame, most: int = SECTION_CHARS) -> DataFrame:
    """``(path, start_line, end_line, heading_path, text)`` of Markdown files."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *section) for path, content in zip(pdf.path, pdf.content, strict=True) for section in heading_sections(content or "", most)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "heading_path", "text"])

    return files.select("path", "content").mapInPandas(make, "path string, start_line int, end_line int, heading_path string, text string")


def hash_embedding(text: str, width: int) -> list[float]:
    """Counts of a text's words by hash, at unit length; a text without words counts as one, as it stands."""
    out = np.zeros(width)
    for word in re.findall(r"\w+", text.lower()) or [text]:
        out[int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") % width] += 1
    return (out / np.sqrt((out * out).sum())).tolist()


def with_embeddings(chunks: DataFrame, width: int = 64, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: hash_embedding(t, width))

    return chunks.withColumn("embedding", embed(text))


PARSED = "path string, has_errors boolean, declared array<struct<name: string, qualified_name: string, kind: string, start_line: int, end_line: int>>"


def parsed_files(files: DataFrame) -> DataFrame:
    """``(path, has_errors, declared)`` of each Python and TypeScript file of ``(path, content)``; a broken file tells what can still be read."""
    names = ("name", "qualified_name", "kind", "start_line", "end_line")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf.path, pdf.language, pdf.content, strict=True):
                found, broken = python_declarations(content or "") if language == "python" else script_declarations(content or "", language == "tsx")
                rows.append((path, broken, [dict(zip(names, d, strict=True)) for d in found]))
            yield pd.DataFrame(rows, columns=["path", "has_errors", "declared"])

    known = files.select("path", "content", X.language("path").alias("language")).where(F.col("language").isin("python", "typescript", "tsx"))
    return known.mapInPandas(make, PARSED)


def declarations(parsed: DataFrame) -> DataFrame:
    """``(path, name, qualified_name, kind, start_line, end_line)`` of parsed files: the symbols table."""
    return parsed.select("path", F.explode("declared").alias("d")).select("path", "d.*")


def unsupported_syntax(parsed: DataFrame) -> DataFrame:
    """``(path, entry_type, reason, detail)``: coverage entries of the files that are broken, and count as texts only."""
    return parsed.where("has_errors").select("path", F.lit("file").alias("entry_type"), F.lit("unsupported_syntax").alias("reason"), F.lit("indexed as text").alias("detail"))


def index_summary(classified: DataFrame, symbols: DataFrame, code_chunks: DataFrame, doc_chunks: DataFrame, unsupported: DataFrame, embeddings: bool) -> DataFrame:
    """One row of what an index holds, and how much it leaves out: entries, texts of unsupported syntax, and vectors that couldn't be had."""
    out = coverage_summary(classified)
    for name, df in (("symbols", symbols), ("code_chunks", code_chunks), ("doc_chunks", doc_chunks), ("unsupported", unsupported)):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    skipped = F.col("skipped") + F.col("unsupported") + (0 if embeddings else 1)
    return out.select("files", "lines", "bytes", "symbols", "code_chunks", "doc_chunks", skipped.alias("skipped"), F.lit(embeddings).alias("embeddings_available"))
