"""Queries of the retrieval operators over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.stems import stem
from tessera.operators import docs as D
from tessera.operators import ingestion as I
from tessera.operators import retrieval as R
from tessera.operators.fulltext import full_text_blocks, full_text_index, full_text_top
from tessera.operators.trigrams import trigram_index
from tessera.plans.common import Registry
from tessera.sources.kept import kept
from tessera.sources.shared import dealt_out, materialize
from tessera.sources.tables import DECLARED_SQL, FILES_SQL, code, files, table

query = Registry()


# SQL pieces. The driver's texts hold Latin letters only, so lower-case and other letters are listed as such.
LOWER = "a-zß-öø-ÿÀ-ÖØ-Þ"


def parts_sql(word: str) -> str:
    cut = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({word}, '_', ' ', 'g'), '([A-Z]+)([A-Z][{LOWER}])', '\\1 \\2', 'g'), '([{LOWER}])([A-Z])', '\\1 \\2', 'g'), '([A-Z{LOWER}])([0-9])', '\\1 \\2', 'g')"
    cut = f"regexp_replace({cut}, '([0-9])([A-Z{LOWER}])', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower({cut}), ' '), lambda x: x <> '')"


def terms_sql(text: str) -> str:
    """A list of a text's identifier terms, in order."""
    return f"flatten(list_transform(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: {parts_sql('w')}), lambda p: CASE WHEN len(p) > 1 THEN list_append(p, array_to_string(p, '')) ELSE p END))"


def lines_sql(content: str) -> str:
    return f"(CASE WHEN {content} = '' THEN [] WHEN {content} LIKE '%\n' THEN string_split({content}, '\n')[:-2] ELSE string_split({content}, '\n') END)"


def trigrams_sql(text: str) -> str:
    words = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: '  ' || w || ' ')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


def score_sql(rows: str, text: str, query: str) -> str:
    """CTEs ``scored``: the rows of table ``rows`` with the resemblance of the whole ``text``, and of the best stretch of it."""
    words = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: '  ' || w || ' ')"
    grams = f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))))"
    stretch = similarity_sql("list_distinct(g[i:j])", "q")
    return f"""gr AS (SELECT *, {grams} AS g, {trigrams_sql(query)} AS q FROM {rows}), ga AS (SELECT *, list_filter(range(1, len(g) + 1), lambda i: list_contains(q, g[i])) AS hits FROM gr),
scored AS (SELECT * EXCLUDE (g, q, hits), {similarity_sql("list_distinct(g)", "q")} AS whole, coalesce(list_max(flatten(list_transform(hits, lambda i: list_transform(list_filter(hits, lambda j: j >= i), lambda j: {stretch})))), 0.0) AS part FROM ga)"""


QUERY, LIMIT, SNAPSHOT = "license", 50, "src3"


@query(f"""
WITH {FILES_SQL}, l AS (SELECT path, unnest({lines_sql("content")}) AS line, generate_subscripts({lines_sql("content")}, 1) AS n FROM files),
hit AS (SELECT path, n, line, rtrim(ltrim(line)) AS t, instr(lower(line), '{QUERY}') - 1 - (length(line) - length(ltrim(line))) AS p FROM l WHERE contains(lower(line), '{QUERY}')),
cut AS (SELECT path, n, t, greatest(0, least(p - 100, length(t) - 300)) AS s FROM hit)
SELECT path, CAST(n AS INT) AS line, CASE WHEN length(t) <= 300 THEN t ELSE
  (CASE WHEN s > 0 THEN '…' ELSE substring(t, 1, 1) END) || substring(t, s + 2, 298) || (CASE WHEN s + 300 < length(t) THEN '…' ELSE substring(t, s + 300, 1) END) END AS snippet
FROM cut ORDER BY path, n LIMIT {LIMIT}""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_search(files(spark, sf_dir), QUERY, LIMIT)


@query(f"""
WITH {FILES_SQL}, l AS (SELECT path, unnest({lines_sql("content")}) AS line, generate_subscripts({lines_sql("content")}, 1) AS n FROM files WHERE snapshot_id = '{SNAPSHOT}'),
hit AS (SELECT path, n, line, rtrim(ltrim(line)) AS t, instr(lower(line), '{QUERY}') - 1 - (length(line) - length(ltrim(line))) AS p FROM l WHERE contains(lower(line), '{QUERY}')),
cut AS (SELECT path, n, t, greatest(0, least(p - 100, length(t) - 300)) AS s FROM hit)
SELECT path, CAST(n AS INT) AS line, CASE WHEN length(t) <= 300 THEN t ELSE
  (CASE WHEN s > 0 THEN '…' ELSE substring(t, 1, 1) END) || substring(t, s + 2, 298) || (CASE WHEN s + 300 < length(t) THEN '…' ELSE substring(t, s + 300, 1) END) END AS snippet
FROM cut ORDER BY path, n LIMIT {LIMIT}""")
def search_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in one snapshot."""
    return R.line_search(R.in_snapshot(files(spark, sf_dir), SNAPSHOT), QUERY, LIMIT)


@query()
def neutral_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a line of Markdown each that does nothing when shown."""
    return files(spark, sf_dir).select("file_id", X.neutral_markdown("content", True).alias("line"))


PATH_QUERY = "en/doc_12"


@query(f"""
WITH {FILES_SQL}, {score_sql("files", "path", f"'{PATH_QUERY}'")},
s AS (SELECT path, content, whole, part, CASE WHEN path = '{PATH_QUERY}' OR string_split(path, '/')[-1] = '{PATH_QUERY}' THEN 0 WHEN contains(lower(path), '{PATH_QUERY}') THEN 1 ELSE 2 END AS tier FROM scored)
SELECT path, CAST(tier AS INT) AS tier, round(greatest(whole, CASE WHEN part >= 0.6 THEN part ELSE 0 END), 9) AS similarity, 1 AS start_line, CAST(greatest(len({lines_sql("content")}), 1) AS INT) AS end_line
FROM s WHERE tier < 2 OR whole >= 0.3 OR part >= 0.6 ORDER BY tier, similarity DESC, length(path), path LIMIT 50""")
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    index = kept(spark, "path-trigrams", f"{sf_dir}/documents.parquet", lambda: trigram_index(f.select("path"), "path", "path"), "part")
    return R.path_search(f, PATH_QUERY, 50, index=index)


DECLARED = "AttionBox"


def symbols_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents' modules declare, parsed once."""
    return kept(spark, "symbols", f"{sf_dir}/documents.parquet", lambda: I.declarations(I.parsed_files(dealt_out(code(spark, sf_dir)))))


SYMBOLS_SQL = f"""l AS (SELECT path, unnest({lines_sql("content")}) AS line, generate_subscripts({lines_sql("content")}, 1) AS n FROM files),
symbols AS (SELECT path, name, CAST(min(n) AS INT) AS line FROM (SELECT path, n, unnest(regexp_extract_all(line, '[\\p{{Lu}}][\\p{{L}}]{{5,}}')) AS name FROM l) GROUP BY ALL)"""


@query(f"""
WITH {DECLARED_SQL},
names AS (SELECT DISTINCT name FROM declared), {score_sql("names", "name", f"'{DECLARED}'")},
s AS (SELECT declared.*, CASE WHEN name = '{DECLARED}' OR qualified_name = '{DECLARED}' THEN 0 WHEN contains(lower(name), lower('{DECLARED}')) OR contains(lower(qualified_name), lower('{DECLARED}')) THEN 1 ELSE 2 END AS tier,
  whole, part, round(greatest(whole, CASE WHEN part >= 0.6 THEN part ELSE 0 END), 9) AS similarity FROM declared JOIN scored USING (name)),
r AS (SELECT * FROM s WHERE tier < 2 OR whole >= 0.3 OR part >= 0.6 ORDER BY tier, similarity DESC, length(name), path, start_line, qualified_name LIMIT 50)
SELECT path, name, qualified_name, kind, start_line, end_line, CAST(tier AS INT) AS tier, similarity, CASE kind
  WHEN 'class' THEN CASE WHEN name = 'Open' THEN 'export class Open {{' WHEN path LIKE '%.py' THEN 'class ' || name || '(Base):
    def ' || lower(left(name, -3)) || '_m(self, a='')''):
        return a'
    ELSE 'export class ' || name || ' {{
  ' || lower(left(name, -3)) || '_m(a: string): void {{
    return `${{a}} {{` + /[{{]/.source' END
  WHEN 'method' THEN CASE WHEN path LIKE '%.py' THEN 'def ' || name || '(self, a='')''):
    return a' ELSE name || '(a: string): void {{
  return `${{a}} {{` + /[{{]/.source
}}' END
  ELSE CASE WHEN name = 'broken' THEN 'def broken(:' WHEN path LIKE '%.py' THEN 'def ' || name || '():
    pass' ELSE 'export const ' || name || ' = (a) => a + 1;' END END AS excerpt FROM r""")
def search_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the declarations of the documents' modules, by plain and qualified name."""
    own = code(spark, sf_dir)
    symbols = symbols_table(spark, sf_dir)
    names = symbols.select("qualified_name").distinct()
    index = kept(spark, "symbol-trigrams", f"{sf_dir}/documents.parquet", lambda: trigram_index(names, "qualified_name", "qualified_name"), "part")
    return R.symbol_search(symbols, own, DECLARED, 50, index=index)


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, substring(path, length('src0/') + 1) AS rest, language, length(content) - length(replace(content, '\n', '')) + CASE WHEN content <> '' AND content NOT LIKE '%\n' THEN 1 ELSE 0 END AS n FROM files WHERE starts_with(path, 'src0/')),
g AS (SELECT split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/')) AS is_directory, min(language) AS language, min(n) AS lines FROM r GROUP BY 1)
SELECT name, is_directory, CASE WHEN NOT is_directory THEN language END AS language, CAST(CASE WHEN NOT is_directory THEN lines END AS INT) AS lines FROM g""")
def list_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_tree(files(spark, sf_dir), "src0/")


@query(f"""WITH {FILES_SQL} SELECT path, 2 AS start_line, CAST(least(6, greatest(len({lines_sql("content")}), 1)) AS INT) AS end_line, array_to_string({lines_sql("content")}[2:6], '\n') AS text
FROM files WHERE path = (SELECT min(path) FROM files) AND 2 <= greatest(len({lines_sql("content")}), 1)""")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    first = f.agg(F.min("path").alias("path")).first().path
    return R.read_lines(f, first, 2, 6)


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(1 - list_inner_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))), 9) AS distance
FROM embeddings, q ORDER BY distance, vec_id LIMIT 20""")
def exact_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    own = vectors.where("vec_id = 7").first()
    return R.exact_nearest(vectors, own.embedding, 20).select("vec_id", F.round("distance", 9).alias("distance"))


@query(f"""WITH {FILES_SQL}, t AS (SELECT file_id, {terms_sql("content")} AS terms FROM files), p AS (SELECT file_id, unnest(terms) AS term FROM t)
SELECT term, count(*) AS positions, count(DISTINCT file_id) AS files FROM p GROUP BY term""")
def postings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.postings(files(spark, sf_dir), "file_id", text="content").groupBy("file_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("term").agg(F.sum("n").alias("positions"), F.count(F.lit(1)).alias("files"))


CHUNKS_SQL = f"""fl AS (SELECT path, {lines_sql("content")} AS l FROM files),
st AS (SELECT path, l, unnest(CASE WHEN len(l) = 0 THEN [] ELSE range(1, 2 + CAST(greatest(ceil((len(l) - 60) / 50.0), 0) AS BIGINT) * 50, 50) END) AS s FROM fl),
chunks AS (SELECT path, CAST(s AS INT) AS start_line, CAST(least(s + 59, len(l)) AS INT) AS end_line, array_to_string(l[s:least(s + 59, len(l))], '\n') AS text FROM st)"""


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL} SELECT path, start_line, end_line, sha256(text) AS text_sha256 FROM chunks")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.window_chunks(files(spark, sf_dir), 60, 10, "path").select("path", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(question_id, question)``: the first user turn of each conversation."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    return turns.groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", F.struct("turn", "text")).alias("question"))


STOP_SQL = ", ".join(f"'{w}'" for w in [*X.STOP_WORDS, *X.CODE_KEYWORDS])
_RULES = " ".join(f"WHEN t LIKE '%{s}' AND length(t) - {len(s)} >= 4 THEN {{'term': left(t, length(t) - {len(s)}), 'prefix': true}}" for s in X.SUFFIXES)
TERMS_SQL = f"""questions AS (SELECT conv_id AS question_id, arg_min(text, (turn, text)) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
w AS (SELECT question_id, generate_subscripts(terms, 1) AS n, unnest(terms) AS t FROM (SELECT question_id, {terms_sql("question")} AS terms FROM questions)),
d AS (SELECT question_id, t, min(n) AS n FROM w WHERE length(t) >= 2 AND t NOT IN ({STOP_SQL}) GROUP BY ALL),
x AS (SELECT question_id, n, CASE {_RULES} ELSE {{'term': t, 'prefix': false}} END AS s FROM d),
y AS (SELECT question_id, s, min(n) AS n FROM x GROUP BY ALL),
terms AS (SELECT question_id, s.term AS term, s.prefix AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n) AS r FROM y) WHERE r <= 64)"""


@query(f"WITH {TERMS_SQL} SELECT * FROM terms")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_terms(questions(spark, sf_dir))


RANKS_SQL = f"""{FILES_SQL}, {CHUNKS_SQL}, {TERMS_SQL},
post AS (SELECT path, start_line, end_line, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM (SELECT *, {terms_sql("substring(text, 1, 100000)")} AS tt FROM chunks)),
counts AS (SELECT path, start_line, end_line, term, least(256, count(DISTINCT least(pos, 16383))) AS n FROM post GROUP BY ALL),
asked AS (SELECT question_id, c.term FROM (SELECT DISTINCT term FROM counts) c JOIN terms ON NOT prefix AND c.term = terms.term
  UNION SELECT question_id, c.term FROM (SELECT DISTINCT term FROM counts) c JOIN terms ON prefix AND left(c.term, 4) = left(terms.term, 4) AND starts_with(c.term, terms.term)),
scored AS (SELECT question_id, path, start_line, end_line, CAST(sum(n) AS DOUBLE) * 0.1 AS score FROM counts JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path, start_line) AS place FROM scored QUALIFY place <= 20)"""


# every place of every term in the whole chunk counts
WHOLE_RANKS_SQL = f"""{FILES_SQL}, {CHUNKS_SQL}, {TERMS_SQL},
post AS (SELECT path, start_line, end_line, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM (SELECT *, {terms_sql("text")} AS tt FROM chunks)),
hits AS (SELECT question_id, path, start_line, end_line, pos FROM post JOIN terms ON NOT prefix AND post.term = terms.term
  UNION ALL SELECT question_id, path, start_line, end_line, pos FROM post JOIN terms ON prefix AND left(post.term, 4) = left(terms.term, 4) AND starts_with(post.term, terms.term)),
scored AS (SELECT question_id, path, start_line, end_line, CAST(count(DISTINCT pos) AS DOUBLE) * 0.1 AS score FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path, start_line) AS place FROM scored QUALIFY place <= 20)"""


CHUNK = ("path", "start_line", "end_line")


def chunk_index(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The full-text index of the windows of all files, within the store's limits or ``whole``; texts are dealt by file once."""
    windows = lambda: R.window_chunks(files(spark, sf_dir).select("path", "content").repartition("path"), 60, 10, "path")
    return kept(spark, "full-text-whole" if whole else "full-text", f"{sf_dir}/documents.parquet", lambda: full_text_blocks(windows(), *CHUNK, whole=whole))


def ranked_chunks(spark: SparkSession, sf_dir: str, most: int = 20, whole: bool = False) -> DataFrame:
    """The best ``most`` chunks of each question by full-text rank, those of one score by path."""
    scored = full_text_top(chunk_index(spark, sf_dir, whole), R.query_terms(questions(spark, sf_dir)), most, ties=False)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "path", "start_line")
    return scored.withColumn("place", F.row_number().over(order))


@query(f"WITH {WHOLE_RANKS_SQL} SELECT question_id, path, start_line, end_line, round(score, 6) AS score, CAST(place AS INT) AS place FROM ranked")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_chunks(spark, sf_dir, whole=True).withColumn("score", F.round("score", 6))


def path_candidates(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """Symbol matches: question terms that equal, in lower case, a declared name; longest names first."""
    symbols = R.declared_symbols(dealt_out(files(spark, sf_dir).select("path", "content"))).select(F.lower("name").alias("term"), "path", "line")
    words = R.query_terms(questions(spark, sf_dir)).where("not prefix").select("question_id", "term")
    # a term gives each of its symbols the same rank, so no question needs more than its first ones
    symbols = R.first_of_each(symbols, most, ("term",), "path", "line")
    hits = symbols.join(words, "term").groupBy("question_id", "path", "line").agg(F.max(F.length("term")).alias("n"))
    order = Window.partitionBy("question_id").orderBy(F.desc("n"), "path", "line")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


CANDIDATES_SQL = f"""{RANKS_SQL}, {SYMBOLS_SQL.replace("l AS", "sl AS", 1).replace("FROM l)", "FROM sl)")},
sym AS (SELECT question_id, path, line, max(length(term)) AS n FROM symbols JOIN terms ON NOT prefix AND lower(name) = term GROUP BY ALL),
symr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, path, line) AS place FROM sym QUALIFY place <= 20),
lists AS (SELECT question_id, 0 AS list_no, place AS rank, path AS item FROM symr UNION ALL SELECT question_id, 1, place, path FROM ranked),
best AS (SELECT question_id, item, list_no, min(rank) AS rank FROM lists GROUP BY ALL),
fused AS (SELECT question_id, item, round(sum(1 / (60.0 + rank)), 12) AS score, min((list_no, rank)) AS first FROM best GROUP BY ALL),
placed AS (SELECT question_id, item, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first) AS place FROM fused)"""


def fused_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = path_candidates(spark, sf_dir).select("question_id", F.lit(0).alias("list_no"), F.col("place").alias("rank"), F.col("path").alias("item"))
    lists = lists.unionByName(ranked_chunks(spark, sf_dir).select("question_id", F.lit(1).alias("list_no"), F.col("place").alias("rank"), F.col("path").alias("item")))
    return R.reciprocal_rank_fusion(lists, "question_id")


@query(f"WITH {CANDIDATES_SQL} SELECT question_id, item, round(score, 9) AS score, CAST(place AS INT) AS place FROM placed")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_paths(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"""WITH {CANDIDATES_SQL}, r AS (SELECT question_id, path, line AS start_line, least(line + 119, line + 5) AS end_line, place FROM symr UNION ALL SELECT question_id, path, start_line, end_line, place FROM ranked),
o AS (SELECT *, max(end_line) OVER (PARTITION BY question_id, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT question_id, path, CAST(min(start_line) AS INT) AS start_line, CAST(max(end_line) AS INT) AS end_line, CAST(min(place) AS INT) AS place FROM i GROUP BY question_id, path, island""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = path_candidates(spark, sf_dir).select("question_id", "path", F.col("line").alias("start_line"), (F.col("line") + 5).alias("end_line"), "place", F.lit("symbol").alias("source_type"))
    code = ranked_chunks(spark, sf_dir).select("question_id", "path", "start_line", "end_line", "place", F.lit("code").alias("source_type"))
    return R.merge_ranges(R.capped_spans(symbols.unionByName(code)).drop("source_type"), "question_id", "path")


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, start_line, end_line, text, embedding)``: the sections of all documents, whose first line counts as a heading."""
    texts = files(spark, sf_dir).select("path", F.concat(F.lit("# "), F.coalesce("content", F.lit(""))).alias("content"))
    return kept(spark, "doc-sections", f"{sf_dir}/documents.parquet", lambda: I.with_embeddings(I.heading_chunks(dealt_out(texts)).drop("heading_path")))


def doc_hits(spark: SparkSession, sf_dir: str, limit: int = D.DOC_CANDIDATES) -> DataFrame:
    """The best sections for each question, by English keywords and by vectors."""
    sections = doc_sections(spark, sf_dir)
    index = kept(spark, "doc-full-text", f"{sf_dir}/documents.parquet", lambda: full_text_blocks(sections, *SECTION, words=D.english_words, stem=stem))
    asked_ = I.with_embeddings(questions(spark, sf_dir), text="question")
    return D.search_docs(index, D.english_terms(questions(spark, sf_dir)), sections, asked_, limit)


SECTION = ("path", "start_line", "end_line")


@query()
def docs_for_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_hits(spark, sf_dir).withColumn("score", F.round("score", 9))


@query()
def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: symbols, code and documentation fused, their ranges merged, and the token budget of each question."""
    symbols = path_candidates(spark, sf_dir).select("question_id", F.lit(0).alias("list_no"), F.col("place").alias("rank"), "path", F.col("line").alias("start_line"), (F.col("line") + 5).alias("end_line"), F.lit("symbol").alias("source_type"))
    code_ = ranked_chunks(spark, sf_dir).select("question_id", F.lit(1).alias("list_no"), F.col("place").alias("rank"), *SECTION, F.lit("code").alias("source_type"))
    docs = doc_hits(spark, sf_dir).select("question_id", F.lit(2).alias("list_no"), F.col("place").alias("rank"), *SECTION, F.lit("doc").alias("source_type"))
    lists = materialize(symbols.unionByName(code_).unionByName(docs), "lists")
    fused = R.reciprocal_rank_fusion(lists.withColumn("item", F.struct(*SECTION, "source_type")), "question_id").select("question_id", "item.*", "place")
    merged = R.merge_ranges(R.capped_spans(fused).drop("source_type"), "question_id", "path")
    order = Window.partitionBy("question_id").orderBy("place")
    return R.build_evidence(merged.withColumn("place", F.row_number().over(order)), files(spark, sf_dir)).drop("excerpt")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, each with a file's name and the end of a path."""
    n = F.col("question_id").cast("string")
    return questions(spark, sf_dir).select("question_id", F.concat("question", F.lit(" see Doc_"), n, F.lit(".txt or (./en/doc_"), n, F.lit(".txt) and well-known Thation-x")).alias("question"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_clean = lambda t: f"regexp_replace(regexp_replace({t}, '^(?:\\.?/|-)+', ''), '[./-]+$', '')"
_ident = "'[/.]|_|[a-z][A-Z]|[A-Z]{2}[a-z]|[0-9]'"
TOKENS_SQL = f"""questions AS (SELECT conv_id AS question_id, arg_min(text, (turn, text)) || ' see Doc_' || conv_id || '.txt or (./en/doc_' || conv_id || '.txt) and well-known Thation-x' AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
tr AS (SELECT question_id, list_transform(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_./-]+'), lambda t: {_clean("t")}) AS raw FROM questions),
tp AS (SELECT question_id, list_filter(flatten(list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[/.]') THEN [t] ELSE list_transform(string_split(t, '-'), lambda u: {_clean("u")}) END)),
  lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AND (regexp_matches(t, {_ident}) OR (length(t) > 2 AND lower(t) NOT IN ({_STOP}) AND regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+')))) AS p FROM tr),
te AS (SELECT question_id, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS n FROM tp),
tokens AS (SELECT question_id, min(n) AS n, arg_min(token, n) AS token FROM te GROUP BY question_id, lower(token))"""


@query(f"WITH {TOKENS_SQL} SELECT question_id, CAST(n AS INT) AS seq, token, regexp_matches(token, {_ident}) AS is_identifier FROM tokens")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.identifier_tokens(asked(spark, sf_dir)).withColumnRenamed("at", "seq")


@query(f"""WITH {FILES_SQL}, {TOKENS_SQL}, fp AS (SELECT path, string_split(path, '/') AS p FROM files),
forms AS (SELECT path, path AS form, 1.0::DOUBLE AS weight FROM fp UNION ALL SELECT path, p[-1], 0.9 FROM fp UNION ALL SELECT path, regexp_replace(p[-1], '^(.+)\\.[^.]*$', '\\1'), 0.8 FROM fp UNION ALL SELECT path, array_to_string(p[i:], '/'), 0.95 FROM (SELECT path, p, unnest(range(2, len(p))) AS i FROM fp)),
s AS (SELECT question_id, path, n, round(weight * CASE WHEN form = token THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN regexp_matches(token, {_ident}) THEN 1.0 ELSE 0.5 END::DOUBLE, 9) AS score FROM tokens JOIN forms ON lower(form) = lower(token)),
b AS (SELECT question_id, path, max(score) AS score, arg_max(n, (score, -n)) AS n FROM s GROUP BY ALL)
SELECT question_id, path, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, path) AS INT) AS place FROM b QUALIFY place <= 20""")
def path_token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_candidates(R.identifier_tokens(asked(spark, sf_dir)), R.path_forms(files(spark, sf_dir)), "path")


@query(f"""WITH {FILES_SQL}, {TOKENS_SQL}, {SYMBOLS_SQL},
s AS (SELECT question_id, path, name, line, n, round(CASE WHEN name = token THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN regexp_matches(token, {_ident}) THEN 1.0 ELSE 0.5 END::DOUBLE, 9) AS score FROM tokens JOIN symbols ON lower(name) = lower(token)),
b AS (SELECT question_id, path, line, name, max(score) AS score, arg_max(n, (score, -n)) AS n FROM s GROUP BY ALL)
SELECT question_id, path, line, name, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, path, line, name) AS INT) AS place FROM b QUALIFY place <= 20""")
def symbol_token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = R.declared_symbols(files(spark, sf_dir)).select("path", "line", "name", F.col("name").alias("form"), F.lit(1.0).alias("weight"))
    return R.exact_candidates(R.identifier_tokens(asked(spark, sf_dir)), forms, "path", "line", "name")


NAMED = " or attionbox.attion_m, TherheanBox"


@query(f"""WITH {DECLARED_SQL}, {TOKENS_SQL.replace("Thation-x", "Thation-x" + NAMED)},
forms AS (SELECT path, qualified_name, start_line, name AS form FROM declared UNION SELECT path, qualified_name, start_line, qualified_name FROM declared),
s AS (SELECT question_id, path, qualified_name, start_line, n, round(CASE WHEN form = token THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN regexp_matches(token, {_ident}) THEN 1.0 ELSE 0.5 END::DOUBLE, 9) AS score FROM tokens JOIN forms ON lower(form) = lower(token)),
b AS (SELECT question_id, path, qualified_name, start_line, max(score) AS score, arg_max(n, (score, -n)) AS n FROM s GROUP BY ALL)
SELECT question_id, path, qualified_name, start_line, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, path, qualified_name, start_line) AS INT) AS place FROM b QUALIFY place <= 20""")
def qualified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations whose name or qualified name a question holds."""
    own = asked(spark, sf_dir).withColumn("question", F.concat("question", F.lit(NAMED)))
    names = F.explode(F.array_distinct(F.array("name", "qualified_name")))
    forms = symbols_table(spark, sf_dir).select("path", "qualified_name", "start_line", names.alias("form"), F.lit(1.0).alias("weight"))
    return R.exact_candidates(R.identifier_tokens(own), forms, "path", "qualified_name", "start_line")


@query(f"""WITH {CANDIDATES_SQL}, t AS (SELECT question_id, item, place, item IN (SELECT path FROM symr s WHERE s.question_id = p.question_id) AS symbol FROM placed p)
SELECT question_id, item, CAST(row_number() OVER (PARTITION BY question_id ORDER BY NOT symbol, place) AS INT) AS place FROM t""")
def symbol_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = path_candidates(spark, sf_dir).select("question_id", F.col("path").alias("item")).distinct().withColumn("source_type", F.lit("symbol"))
    fused = fused_paths(spark, sf_dir).join(symbols, ["question_id", "item"], "left").withColumn("source_type", F.coalesce("source_type", F.lit("code")))
    return R.symbol_first(fused, "question_id").select("question_id", "item", "place")


@query()
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and vectors of one question over all windows of all documents."""
    question = spark.range(1).select(F.lit(1).alias("question_id"), F.lit("bleed reaning license heating").alias("question"))
    chunks = R.window_chunks(files(spark, sf_dir), 60, 10, "path")
    found = D.search_docs(full_text_index(chunks, *SECTION), R.query_terms(question), I.with_embeddings(chunks), I.with_embeddings(question, text="question"), 20)
    return found.drop("question_id")


@query()
def english_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(term, positions, files)`` of the English stems of whole documents."""
    own = files(spark, sf_dir).select("file_id", D.english_words("content").alias("words")).select("file_id", F.explode("words").alias("question"))
    counts = own.groupBy("file_id", "question").agg(F.count(F.lit(1)).alias("n"))
    stems = D.english_terms(counts.select("question").distinct(), key="question").select("question", "term")
    return counts.join(stems, "question").groupBy("term").agg(F.sum("n").alias("positions"), F.count_distinct("file_id").alias("files"))


@query("SELECT page_id, 'https://example.com/r/' || replace(replace(url_encode(url), '%2F', '/'), '+', '%20') AS link, length(html) / 3.5 AS tokens FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", X.quoted_url("https://example.com/r/", "url").alias("link"), X.estimated_tokens("html").alias("tokens"))
