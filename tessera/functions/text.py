"""Text functions: lines, identifiers, paths, trigrams, snippets. All are column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
SNIPPET_CHARS = 300
SNIPPET_LINES = 3

# fixed values: words dropped from questions, and from full-text terms
STOP_WORDS = """
a about above after again against all also am an and any are aren as at be because been before being below between both but by
can cannot could couldn did didn do does doesn doing don done down during each either else etc ever every few for from further
get gets got had has have having he her here hers herself him himself his how however i if in into is isn it its itself just
let like may me might more most much must my myself no nor not now of off on once only or other our ours out over own please
same shall she should shouldn show so some such tell than that the their theirs them themselves then there these they this
those through to too under until up upon us use used uses using very via was wasn we were weren what when where whether which
while who whom whose why will with within without won would wouldn yes yet you your yours
""".split()
CODE_KEYWORDS = "async await class const def elif export false function import lambda let new none null pass return self true var yield".split()
SUFFIXES = ("ing", "ies", "es", "ed", "s")
LEAST_STEM = 4
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]+"
WORD = re.compile(r"[^\W_]+")
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".md": "markdown", ".mdx": "markdown"}


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lines(content: str | Column) -> Column:
    """Lines split at line feeds only; a final one opens no line; an empty text has none."""
    parts = F.split(_c(content), "\n", -1)
    return F.when(_c(content) == "", F.array().cast("array<string>")).when(F.endswith(_c(content), F.lit("\n")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def line_count(content: str | Column) -> Column:
    c = _c(content)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when((c != "") & ~F.endswith(c, F.lit("\n")), 1).otherwise(0)).cast("int")


def language(path: str | Column) -> Column:
    """Language by file suffix; ``text`` for all others."""
    name, out = F.lower(basename(path)), None
    for suffix, value in LANGUAGES.items():
        rule = F.endswith(name, F.lit(suffix))
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out.otherwise("text")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: str | Column) -> Column:
    """The file name without its last suffix; names without a dot, and dot files, stay whole."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def area(path: str | Column) -> Column:
    """The first two folders of a path, or ``(root)``."""
    folders = F.slice(F.split(_c(path), "/"), 1, F.least(F.size(F.split(_c(path), "/")) - 1, F.lit(2)))
    return F.when(F.contains(_c(path), F.lit("/")), F.array_join(folders, "/")).otherwise("(root)")


def module_name(path: str | Column) -> Column:
    """The dotted import path of a file; that of a package's ``__init__`` is the package's."""
    return F.replace(F.regexp_replace(F.regexp_replace(_c(path), r"\.[^./]*$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def normal_path(path: str | Column) -> Column:
    """Path without ``.`` and empty segments; null for one with ``..``, a backslash or a NUL."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: ~x.isin("", "."))
    bad = F.array_contains(parts, "..") | F.contains(_c(path), F.lit("\\")) | F.contains(_c(path), F.lit("\0"))
    return F.when(~bad, F.array_join(parts, "/"))


def contains_folded(column: str | Column, query: str) -> Column:
    """Substring test without regard to case; wildcards of the query match themselves."""
    return F.contains(F.lower(_c(column)), F.lit(query.lower()))


def escape_like(value: str) -> str:
    """A LIKE pattern (escape character ``\\``) that matches ``value`` itself anywhere."""
    return "%" + value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def split_identifiers(text: str | Column) -> Column:
    """Lower-case terms: of each word its camel-case, underscore and digit parts, then the parts joined if several.

    The places where words part are marked in one pass over the whole text; only words with a mark are taken apart.
    """
    mark, low = "\1", r"\p{IsAlphabetic}\p{M}\p{Pc}\u200c\u200d&&[^A-Z_]"
    letter, digit = r"\p{IsAlphabetic}\p{M}\p{Pc}\u200c\u200d&&[^_]", r"\p{Nd}"
    # what is rare in prose is tested first
    parts = rf"_+|(?=[A-Z])(?:(?<=[{low}])|(?<=[A-Z])(?=.[{low}]))|(?={digit})(?<=[{letter}])|(?<={digit})(?=[{letter}])"
    plain = F.translate(_c(text), mark, " ")
    words = F.regexp_extract_all(F.lower(F.regexp_replace(plain, parts, mark)), F.lit(rf"[\p{{IsAlphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}‌‍{mark}]+"), F.lit(0))

    def terms(word: Column) -> Column:
        own = F.filter(F.split(word, mark), lambda x: x != "")
        return F.when(F.size(own) > 1, F.concat(own, F.array(F.array_join(own, "")))).otherwise(own)

    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit(mark)), terms(w)).otherwise(F.array(w))))


def separate_scripts(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), f"({CJK})", " $1 ")


def strip_suffix(term: str) -> tuple[str, bool]:
    """A term's stem, and whether a suffix was dropped (it then matches as a prefix)."""
    for suffix in SUFFIXES:
        if term.endswith(suffix) and len(term) - len(suffix) >= LEAST_STEM:
            return term[: -len(suffix)], True
    return term, False


def trigrams(text: str | Column) -> Column:
    """The set of three-letter runs of the words, each padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of trigrams."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def best_stretch(grams: list[str], asked: set[str]) -> float:
    """The greatest similarity of ``asked`` and any stretch of ``grams``; a best one starts and ends with one that is asked for."""
    best, ends = 0.0, [i for i, g in enumerate(grams) if g in asked]
    for start in ends:
        held: set[str] = set()
        common = 0
        for gram in grams[start : ends[-1] + 1]:
            if gram not in held:
                held.add(gram)
                common += gram in asked
            best = max(best, common / (len(asked) + len(held) - common))
    return best


def word_similarity(query: str, text: str | Column, least: float) -> Column:
    """The greatest similarity of ``query``'s trigrams and any stretch of ``text``'s, in order; zero where it is below ``least``.

    A stretch that reaches ``least`` holds that share of the query's trigrams, so other texts are not looked into.
    """
    padded = lambda t: [f"  {w} " for w in WORD.findall(t.lower())]
    made = lambda t: [w[i : i + 3] for w in padded(t) for i in range(len(w) - 2)]
    asked = set(made(query))

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_stretch(made(t), asked) if t else 0.0)

    spaced = F.concat(F.lit("  "), F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    held = sum((F.contains(spaced, F.lit(g)).cast("int") for g in sorted(asked)), F.lit(0))
    score = best(F.when((held > 0) & (held >= len(asked) * least), _c(text)))
    return F.when(score >= least, score).otherwise(0.0)


# fixed values: what acts in Markdown where it is shown
CODE_SPAN = r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
ACTIVE = r"(?i)((?<![\w@])@[a-z0-9][\w-]*(?:/[\w.-]+)?|#\d+\b|\bGH-\d+\b)"
BLOCK_MARK, NUMBER_MARK = r"^([#>+*=|~-])", r"^(\d+)([.)])"


def neutral_markdown(text: str | Column, leading: bool = False) -> Column:
    """A text as one line that does nothing when shown as Markdown: outside inline code, HTML, brackets, backslashes and stray
    backticks are escaped and mentions become code; with ``leading``, what would open a block at a line's start too."""
    flat = F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))

    def plain(part: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            part = F.replace(part, F.lit(sign), F.lit(name))
        return F.regexp_replace(F.regexp_replace(part, r"([\\`\[\]])", r"\\$1"), ACTIVE, "`$1`")

    parts = F.transform(F.split(flat, CODE_SPAN, -1), plain)
    code = F.regexp_extract_all(flat, F.lit(CODE_SPAN), F.lit(0))
    out = F.array_join(F.zip_with(parts, code, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.regexp_replace(F.regexp_replace(out, BLOCK_MARK, r"\\$1"), NUMBER_MARK, r"$1\\$2") if leading else out


def merged_json(a: str | Column, b: str | Column) -> Column:
    """Two JSON objects as one text: all keys of both by name, the second's values where both have one."""
    read = lambda c: F.coalesce(F.from_json(_c(c), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    named = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that is made once, however often it is used
    quoted = lambda k: named(F.to_json(F.array(k)), lambda q: q.substr(F.lit(2), F.length(q) - 2))
    written = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(quoted(k), F.lit(":"), F.to_json(F.element_at(m, k)))), ",")
    both = named(read(b), lambda second: F.map_concat(F.map_filter(read(a), lambda k, _: ~F.map_contains_key(second, k)), second))
    return F.concat(F.lit("{"), named(both, written), F.lit("}"))


#: White space as texts have it; Java's class lacks the separators of information.
SPACE = r"[\s\x1c-\x1f]"


def stripped(text: Column, left: bool = True, right: bool = True) -> Column:
    """A text without white space of any kind at its ends."""
    text = F.regexp_replace(text, f"(?U)^{SPACE}+", "") if left else text
    return F.regexp_replace(text, f"(?U){SPACE}+$", "") if right else text


def common_start(a: Column, b: Column) -> Column:
    """What two texts begin with."""
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i))
    return a.substr(F.lit(1), F.array_max(same))


def snippet(text: str | Column) -> Column:
    """The first three lines that aren't blank, without the blanks and tabs that all of them begin with, at most 300 characters."""
    kept = F.slice(F.filter(F.split(_c(text), "\n"), lambda x: stripped(x) != ""), 1, SNIPPET_LINES)
    kept = F.transform(kept, lambda x: stripped(x, left=False))
    indents = F.transform(kept, lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    indent = F.length(F.aggregate(F.slice(indents, 2, SNIPPET_LINES), F.coalesce(F.get(indents, F.lit(0)), F.lit("")), common_start))
    out = stripped(F.array_join(F.transform(kept, lambda x: x.substr(indent + 1, F.length(x))), "\n"))
    return F.when(F.length(out) <= SNIPPET_CHARS, out).otherwise(F.concat(stripped(F.substring(out, 1, SNIPPET_CHARS - 1), left=False), F.lit("…")))


def spaced_snippet(text: str | Column) -> Column:
    """As :func:`snippet`, but only separators of words are white space, as SQL's ``trim`` has it: tabs count as letters, and a line feed may stand before ``…``."""
    left, right = (lambda x: F.regexp_replace(x, r"^\p{Zs}+", "")), (lambda x: F.regexp_replace(x, r"\p{Zs}+\z", ""))
    kept = F.transform(F.slice(F.filter(F.split(_c(text), "\n"), lambda x: left(x) != ""), 1, SNIPPET_LINES), right)
    indent = F.array_min(F.transform(kept, lambda x: F.length(x) - F.length(left(x))))
    out = left(right(F.array_join(F.transform(kept, lambda x: x.substr(indent + 1, F.length(x))), "\n")))
    return F.when(F.length(out) <= SNIPPET_CHARS, out).otherwise(F.concat(right(F.substring(out, 1, SNIPPET_CHARS - 1)), F.lit("…")))


def line_snippet(line: Column, position: Column) -> Column:
    """A line without outer white space; a long one is cut to a window around ``position`` (from 0), and ``…`` stands where it is cut."""
    left = stripped(line, right=False)
    text = stripped(left, left=False)
    size, at = F.length(text), position - (F.length(line) - F.length(left))
    first = F.greatest(F.lit(0), F.least(at - SNIPPET_CHARS // 3, size - SNIPPET_CHARS))
    last = F.least(size, first + SNIPPET_CHARS)
    before, behind = (first > 0).cast("int"), (last < size).cast("int")
    inner = text.substr(first + before + 1, last - first - before - behind)
    mark = lambda shown: F.when(shown == 1, "…").otherwise("")
    return F.when(size <= SNIPPET_CHARS, text).otherwise(F.concat(mark(before), inner, mark(behind)))


def estimated_tokens(text: str | Column) -> Column:
    return F.length(_c(text)) / CHARS_PER_TOKEN


def index_version(*parameters: str) -> Column:
    return F.concat(F.lit("idx-"), F.substring(F.sha2(F.lit("\n".join(parameters)), 256), 1, 12))


def redacted_url(url: str | Column) -> Column:
    """A URL whose query string is replaced."""
    return F.regexp_replace(_c(url), r"\?.*", "?[redacted]")


def quoted_url(base: str, path: str | Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(_c(path)), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def is_test_path(path: str | Column) -> Column:
    """A file below tests, test or __tests__, or named like a test."""
    return _c(path).rlike(r"(^|/)(tests|test|__tests__)/|(^|/)(test_[^/]*\.py|[^/]*_test\.py|[^/]*\.(test|spec)\.tsx?)$")


# fixed values: the fields that a log may hold
LOGGED = (
    "method", "route", "status", "duration_ms", "kind", "outcome", "attempt", "provider", "queued_jobs", "oldest_runnable_job_age_seconds", "database_revision", "release_revision",
    "commit", "reported_commit", "object_key", "bytes", "pruned",
)


def log_entry(fields: str | Column) -> Column:
    """``name=value`` of the fields of a map that may be logged, by name; all others are left out, whatever they hold."""
    kept = F.map_filter(_c(fields), lambda k, v: k.isin(*LOGGED) & v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.element_at(kept, k))), ",")
