"""The inverted index in blocks and the best chunks by bounds, against counting every place of every chunk."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import fulltext, retrieval
from tessera.plans import registry


def model(chunks, terms, k):
    """All chunks of the k best scores of each question: every place counted."""
    out = set()
    for question in {q for q, _, _ in terms}:
        asked = [(t, prefix) for q, t, prefix in terms if q == question]
        score = {}
        for unit, words in chunks:
            places = Counter()
            for at, w in enumerate(words, 1):
                places[w, min(at, fulltext.LAST_PLACE)] = 1
            n = Counter()
            for w, _ in places:
                n[w] += 1
            own = sum(min(c, fulltext.MOST_PLACES) for w, c in n.items() if any(w == t or prefix and w.startswith(t) for t, prefix in asked))
            if own:
                score[unit] = own
        least = sorted(score.values(), reverse=True)[:k][-1:] or [0]
        out |= {(question, u, round(n * 0.1, 9)) for u, n in score.items() if n >= least[0]}
    return out


def test_best_chunks_of_many_questions(spark, monkeypatch):
    rng = random.Random(1)
    words = ["license", "licensed", "licenses", "heat", "heating", "rare", "aaaa", "b", "café", "zz9"] + [f"w{chr(97 + i)}" for i in range(20)]
    chunks = [(i, [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200]))]) for i in range(400)]
    chunks += [(1000, ["heat"] * 700), (1001, ["rare"] * 20_000 + ["heat"] * 5 + ["zz9"]), (1002, [])]
    monkeypatch.setattr(fulltext, "SEARCHED_CHARS", 10**9)
    expanded = lambda ws: [p for w in ws for p in ({"zz9": ["zz", "9", "zz9"]}.get(w, [w]))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in chunks] + [(2000, None)], "unit long, text string").repartition(3)
    terms = [(q, rng.choice(words + ["absent"]), False) for q in range(25) for _ in range(rng.randint(1, 6))] + [(q, "lice", True) for q in range(0, 25, 3)] + [(99, "absent", False), (7, "heat", True)]
    asked = spark.createDataFrame(sorted(set(terms)), "q long, term string, prefix boolean")
    want = model([(i, expanded(w)) for i, w in chunks], sorted(set(terms)), 5)
    for pairs in (2_000_000, 40):  # one pass over the index, and several
        monkeypatch.setattr(fulltext, "MOST_PAIRS", pairs)
        got = fulltext.full_text_top(fulltext.full_text_index(df, "unit"), asked, 5, "q")
        assert {(r.q, r.unit, round(r.score, 9)) for r in got.collect()} == want
    empty = fulltext.full_text_top(fulltext.full_text_index(df.limit(0), "unit"), asked, 5, "q")
    assert empty.columns == got.columns and empty.count() == 0
    assert fulltext.full_text_top(fulltext.full_text_index(df, "unit"), asked.limit(0), 5, "q").count() == 0


def test_blocks_below_the_threshold_stay_closed():
    """Long chunks come first; after them no block of short ones can reach the best, and its postings aren't read."""
    rng = random.Random(2)
    blocks = []
    for length in [400] * 4 + [20] * 60:
        rows = [pa.array([rng.choice("abcdefgh") for _ in range(length)]) for _ in range(fulltext.BLOCK)]
        blocks.append((rows, fulltext.block_of(rows)))
    pairs = pa.table({"q": pa.array([1, 1, 1, 2, 2]), "term": pa.array(["a", "b", "x", "b", "c"])})
    scorer = fulltext.Scorer(fulltext.Asked(pairs, "q"), 10)
    found = [(q, (number, at), n) for number, (_, (terms, *lists)) in enumerate(blocks) for q, at, n in scorer.block(terms, *map(np.asarray, lists))]
    for q, asked in ((0, "ab"), (1, "bc")):
        every = sorted((sum(w in asked for w in row.to_pylist()) for rows, _ in blocks for row in rows), reverse=True)
        assert sorted((n for own, _, n in found if own == q and n >= scorer.least[own]), reverse=True)[:10] == every[:10]
    assert scorer.met == sum(2 * fulltext.BLOCK * 2 for _ in blocks[:4]) + sum(int(np.isin(lists[0].to_pylist(), list("ab")) @ np.diff(np.append(lists[2], len(lists[3])))) + int(np.isin(lists[0].to_pylist(), list("bc")) @ np.diff(np.append(lists[2], len(lists[3])))) for _, lists in blocks[4:])
    assert scorer.opened == 4 * 4 * fulltext.BLOCK < 0.1 * scorer.met


def test_search_of_documents_uses_the_index(spark):
    files = spark.createDataFrame([("a", "license text\nmore"), ("b", "other words")], "path string, content string")
    index = fulltext.full_text_index(retrieval.window_chunks(files, 60, 10, "path"), "path", "start_line", "end_line")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "what license")], "question_id int, question string"))
    assert [(r.path, round(r.score, 6)) for r in fulltext.full_text_top(index, terms, 3).collect()] == [("a", 0.1)]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Texts beyond each of the store's limits: 256 places of a term, place 16,383 and 100,000 characters."""
    at = str(tmp_path_factory.mktemp("long"))
    texts = ["heat " * 300, "heat " * 700, "rare " * 20_000 + "heat heat", None, "", "heat\nrare"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    asked = [(1, 0, "user", "heat"), (2, 0, "user", "where is the rare heating")]
    spark.createDataFrame(asked, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return at


def test_full_text_search_counts_every_place_of_whole_texts(spark, long_texts):
    found = [tuple(r) for r in registry.QUERIES["full_text_search"](spark, long_texts).select("question_id", "place", "path", "score").orderBy("question_id", "place").collect()]
    doc = "s/en/doc_{}.txt".format
    assert found == [
        (1, 1, doc(1), 70.0), (1, 2, doc(0), 30.0), (1, 3, doc(2), 0.2), (1, 4, doc(5), 0.1),
        (2, 1, doc(2), 2000.2), (2, 2, doc(1), 70.0), (2, 3, doc(0), 30.0), (2, 4, doc(5), 0.2),
    ]


@pytest.mark.parametrize("name", ["full_text_search", "hybrid_retrieval", "merged_ranges"])
def test_long_texts_match_the_sql(spark, long_texts, name):
    """Whole or within the limits, as each query's SQL has it."""
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{long_texts}/{table}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    assert sorted(map(tuple, registry.QUERIES[name](spark, long_texts).select(*want.columns).collect())) == sorted(want.fetchall())


def test_long_texts_close_a_block_early(spark, monkeypatch):
    df = spark.createDataFrame([(i, "heat " * (i % 7)) for i in range(100)], "unit long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "heat", False)], "q long, term string, prefix boolean")
    told = lambda: sorted(map(tuple, fulltext.full_text_top(fulltext.full_text_index(df, "unit", whole=True), asked, 5, "q").collect()))
    want = told()
    assert {round(r[2], 9) for r in want} == {0.6} and len(want) == 14
    monkeypatch.setattr(fulltext, "BLOCK_BYTES", 40)
    assert fulltext.full_text_index(df, "unit", whole=True).count() > 2
    assert told() == want


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_a_task_holds_no_more_than_the_best_of_a_question(spark, monkeypatch, held):
    """Of 3,000 chunks of one score the first by name are told, and no task keeps more of them than are asked for."""
    monkeypatch.setattr(fulltext, "HELD", held)
    names = [f"{i * 7919 % 3000:04d}" for i in range(3000)]
    index = fulltext.full_text_index(spark.createDataFrame([(n, "heat rare" if n < "0002" else "heat") for n in names], "unit string, text string").repartition(2), "unit")
    assert index.count() > fulltext.LEADING  # so the longest are scored first
    asked = spark.createDataFrame([(1, "heat", False), (2, "heat", True), (2, "rare", False), (2, "heated", True)], "q long, term string, prefix boolean")
    found = fulltext.full_text_top(index, asked, 4, "q", ties=False)
    assert sorted((r.q, r.unit, round(r.score, 6)) for r in found.collect()) == [(1, f"000{i}", 0.1) for i in range(4)] + [(2, f"000{i}", 0.2 if i < 2 else 0.1) for i in range(4)]
    scorer = fulltext.Scorer(fulltext.Asked(pa.table({"q": [1], "term": ["heat"]}), "q"), 4)
    told = fulltext.Told(scorer, ties=False)
    for at in range(0, 3000, fulltext.BLOCK):
        own = names[at : at + fulltext.BLOCK]
        block_terms, *lists = fulltext.block_of([pa.array(["heat"])] * len(own))
        told.add(pa.StructArray.from_arrays([pa.array(own)], ["unit"]), scorer.block(block_terms, *map(np.asarray, lists)))
        assert told.held <= 2 * max(held, 4) + fulltext.BLOCK
    assert len(told.best()) == 4
