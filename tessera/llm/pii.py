"""Personal data: identifiers by pattern, and terms that give them away by information content.

Base spans are found by pattern and check digit. All words of a text outside its spans are candidate terms
of the entities that it holds. Over all distinct texts, a term t discloses an entity e by its pointwise
mutual information ``log2(N n(t,e) / (n(t) n(e)))``, n counting texts. In the texts that hold e, each
occurrence of t is generalised (to its kind of word) where that reaches ``DISCLOSURE`` of the entity's own
information content ``-log2(n(e) / N)`` and at least ``SUPPORT`` distinct texts show the pair, and removed
where it reaches ``REMOVAL``. In fewer texts every word that stands nowhere else would reach both.
A text is known by its SHA-256, so that no other text gets its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches, join_counted, materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
DISCLOSURE = 0.75
REMOVAL = 0.95
COUNTER_ROWS = 200_000
#: Keys of 32 bytes that are sent to each task at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000

# fixed values: the patterns of the contract, with a look-behind where a later start within the same
# run of digits can't match either
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: its local part is the whole run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def entity(kind: str, found: str) -> str:
    """One name for all spellings of an identifier."""
    return f"{kind}:{found.lower() if kind == 'email' else found if kind == 'ip' else ''.join(DIGIT.findall(found))}"


def terms_of(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text))}


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words of ``text`` that touch no span."""
    taken, k, reached = sorted((a, b) for _, a, b in spans), 0, 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reached, k = max(reached, taken[k][1]), k + 1
        if m.start() >= reached:
            yield m


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("base", SPANS), T.StructField("text", T.StringType())])


def text_key() -> Column:
    return F.unhex(F.sha2(text_or_empty(), 256))


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_or_empty().alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, base, text)`` of each row: its base spans, and its text where it has some."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, held = [], []
            for text in batch.column(2):
                text = text.as_py()
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                held.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(base, pa.list_(SPAN)), pa.array(held, pa.string())], names=FOUND.names)

    return _source(docs).mapInArrow(make, FOUND)


def copies(found: DataFrame) -> DataFrame:
    """``(text_key, copies)``: each distinct text and the rows that have it."""
    return found.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))


def term_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(term, n)``: distinct texts of ``docs`` that hold each term; ``known`` is its :func:`copies`.

    Each task adds up rows by term and number of copies before the shuffle. All copies of a text are
    counted under the same number, so that dividing by it leaves each text once, exactly.
    """

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([c for _, c in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "copies", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text, times in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total.update((t, times) for t in terms_of(text.as_py()))
                if len(total) > COUNTER_ROWS:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    # texts without copies need no entry; where the others' keys fit into the tasks, no text is shuffled
    several = known.where("copies > 1")
    size, texts = several.agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows")).first(), _source(docs).select("text_key", "text")
    if size["keys"] <= BROADCAST_KEYS:
        told = texts.join(F.broadcast(several), "text_key", "left")
    else:
        told = join_counted(texts, several.withColumn("n", F.col("copies")), "text_key", "n", size["rows"], "left")
    told = told.select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = told.mapInArrow(make, "term string, copies long, n long").groupBy("term", "copies").agg(F.sum("n").alias("n"))
    return counted.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n"))


def holders(found: DataFrame) -> DataFrame:
    """``(text_key, text)``: each distinct text that holds an entity."""
    return materialize(found.where("text is not null").groupBy("text_key").agg(F.first("text").alias("text")), "holders")


def described(texts: DataFrame) -> DataFrame:
    """``(text_key, entities, terms)`` of :func:`holders`, each named once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities, terms = [], []
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text)
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                terms.append(sorted({m[0].lower() for m in outside(text, spans)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))], names=["text_key", "entities", "terms"])

    return texts.mapInArrow(make, "text_key binary, entities array<string>, terms array<string>")


def grouped_entities(each: DataFrame, support: int) -> DataFrame:
    """``(entity, n_entity, group)`` of the entities that stand in ``support`` texts of ``(text_key, entity)``: those that stand in the same texts are one group.

    What a term discloses of an entity depends on the entity's texts alone, so a list that is repeated, however long, is one
    group and not as many entities. Sets of texts are told apart by their number and 128 bits.
    """
    same = ("n_entity", "a", "b")
    bits = [F.bit_xor(F.xxhash64(F.lit(seed), "text_key")).alias(name) for seed, name in enumerate("ab")]
    counted = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *bits).where(F.col("n_entity") >= support)
    counted = materialize(counted, "entity-texts")
    groups = counted.groupBy(*same).agg(F.min("entity").alias("group"))
    return materialize(counted.join(groups, list(same)).select("entity", "n_entity", "group"), "entities")


def disclosing_terms(docs: DataFrame, found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(text_key, entity, term, share)``: what a term discloses, ``share`` >= ``disclosure``, of an entity of the same text."""
    told, entities = disclosing_groups(docs, found, texts, support, disclosure)
    return told.join(entities.select("entity", "group"), "group").select("text_key", "entity", "term", "share")


def disclosing_groups(docs: DataFrame, found: DataFrame, texts: DataFrame, support: int, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """``(text_key, group, term, share)`` for groups of entities, and :func:`grouped_entities`.

    Pairs, entities and terms are counted over distinct texts, so copies are no evidence. As
    n(t,e) <= n(t) and n(t,e) <= n(e), no pair whose term stands in fewer than ``support`` texts, or in more than
    ``N ** (1 - disclosure) * n(e) ** disclosure``, can reach the measure; those are left out before pairs are made.
    """
    parts = described(texts)
    each = parts.select("text_key", F.explode("entities").alias("entity"))
    entities = grouped_entities(each, support)
    if entities.isEmpty():
        return each.select("text_key", F.col("entity").alias("group"), F.lit("").alias("term"), F.lit(1.0).alias("share")).limit(0), entities
    known = materialize(copies(found), "copies")
    total = F.lit(float(max(known.count(), 1)))
    most = lambda n: F.pow(total, F.lit(1 - disclosure)) * F.pow(n, F.lit(disclosure)) * 1.000001
    sizes = entities.agg(F.max("n_entity").alias("most"), F.sum("n_entity").alias("rows")).first()
    counts = term_counts(docs, known).withColumnRenamed("n", "n_term").where(F.col("n_term") >= support)
    # terms that are too common to disclose stay until they are joined, so that their rows are dealt by a salt too: those
    # of a thousandth of all texts are no more than a thousand times the terms of a text
    counts = materialize(counts.withColumn("n", F.col("n_term")), "term-counts")
    held = join_counted(each, entities.withColumn("n", F.col("n_entity")), "entity", "n", sizes["rows"]).where(F.col("n_entity") < total)
    held = held.select("text_key", "group", "n_entity").distinct()
    words = join_counted(parts.select("text_key", F.explode("terms").alias("term")), counts, "term", "n", known.count())
    words = words.where(F.col("n_term") <= most(F.lit(float(sizes["most"]))))
    near = materialize(held.join(words, "text_key").where(F.col("n_term") <= most(F.col("n_entity"))), "near")
    pairs = near.groupBy("group", "term").agg(F.count(F.lit(1)).alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    content = -F.log2(F.col("n_entity") / total)
    gain = F.log2(total * F.col("n_pair") / (F.col("n_entity") * F.greatest("n_term", "n_pair")))
    telling = pairs.where(F.col("n_pair") >= support).withColumn("share", gain / content).where(F.col("share") >= disclosure)
    telling = materialize(telling.select("group", "term", "share", "n_pair"), "telling")
    return join_counted(near.select("text_key", "group", "term"), telling, ["group", "term"], "n_pair", near.count()), entities


def added_spans(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """``(text_key, added)``: for each text, sorted spans ``(kind, start, end)`` of every occurrence of its disclosing terms."""
    texts = holders(found)
    told, _ = disclosing_groups(docs, found, texts, support, disclosure)
    marks = told.groupBy("text_key", "term").agg((F.max("share") >= removal).alias("removed"))
    marked = texts.join(marks.groupBy("text_key").agg(F.collect_list(F.struct("term", "removed")).alias("marks")), "text_key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = []
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                text, kinds = text.as_py(), {m["term"]: "term_removed" if m["removed"] else "term_general" for m in marks.as_py()}
                words = ((kinds.get(m[0].lower()), *m.span()) for m in outside(text, base_spans(text)))
                added.append([{"kind": k, "start": a, "end": b} for k, a, b in words if k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, pa.list_(SPAN))], names=["text_key", "added"])

    return marked.mapInArrow(make, T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("added", SPANS)]))


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, base, added)`` of each row of ``docs``; null and empty texts have no spans."""
    found = materialize(find(docs), "found")
    none = F.array().cast(SPANS)
    return found.join(added_spans(docs, found, **options), "text_key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def general(term: str) -> str:
    """The kind of word that stands for a disclosing term: a number, a name (it has a capital first) or another word."""
    return "[NUMBER]" if term[0].isdigit() else "[NAME]" if term[0].isupper() else "[WORD]"


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each identifier replaced by its kind, each generalised term by that of :func:`general`, and removed
    terms by nothing; overlaps are merged."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < done:
            if end > done:
                done = end
            continue
        out += [text[done:start], "" if kind == "term_removed" else general(text[start:end]) if kind == "term_general" else f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns and all rows stay, null texts too."""
    found = materialize(find(docs), "found")
    added = added_spans(docs, found, **options).withColumnRenamed("text_key", "__key").withColumnRenamed("added", "__added")
    joined = docs.withColumn("__own", text_key()).join(added, F.col("__own") == F.col("__key"), "left").drop("__own", "__key")
    at = docs.columns.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in zip(batch.column(at), batch.columns[-1], strict=True):
                text = text.as_py()
                spans = base_spans(text) if text else []
                spans += [(x["kind"], x["start"], x["end"]) for x in more.as_py() or []]
                texts.append(redact(text, spans) if spans else text)
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(make, docs.schema)
