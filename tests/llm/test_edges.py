"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest

from tessera.llm import chunks, collocations, decontam, licenses, mixing, packing, pii, quality, queries, secrets, simhash, spelling, tokens

LONG = "A long text, with some words. " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, fp long, component_id long, base string, term string, n long, w string, h string, rank int, bucket int, digest long, length long, candidate string, item_id long"
ROWS = [
    (1, "Write to a.b@mail1.example.com now", "en", "s", 34), (1, "Write to a.b@mail1.example.com now", "en", "s", 34), (2, None, None, None, None), (3, "", "en", "s", 0),
    (None, "a text of nobody", "en", "s", 16), (4, " \t\n", "en", None, 3), (5, LONG, "en", "s", len(LONG)), (6, "é漢字🎉 Licensed under CC BY-NC 4.0.", "xx", "s", 9), (7, 'token = "0123456789abcdef0123456789abcdef01234567"', "en", "s", 51),
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = tuple(None for _ in CLASHING.split(", "))
    return spark.createDataFrame([r + clash for r in ROWS], f"{SCHEMA}, {CLASHING}").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (3, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some words a long text with some"), (None, "x y z"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.made_findings(spark, 600))


def cases(labels, benchmark, forest, spark):
    path = queries.tokenizer_path()
    return {
        "chunks": (lambda d: chunks.repeated_passages(d), None),
        "without_repeats": (chunks.without_repeats, len(ROWS)),
        "quality": (lambda d: quality.score(d, quality.train(d, labels), "score"), len(ROWS)),
        "accepted": (lambda d: quality.accepted(d, labels), None),
        "licenses": (licenses.license_notices, 1),
        "secrets": (lambda d: secrets.secrets(d, forest), None),
        "pii": (pii.personal_data, len(ROWS)),
        "sanitise": (pii.sanitise, len(ROWS)),
        "simhash": (simhash.near_duplicates, len(ROWS)),
        "one_of_each": (simhash.one_of_each, None),
        "tokens": (lambda d: tokens.token_counts(d, queries.tokenizer_path("piece_bpe_32k.model")), len(ROWS)),
        "packing": (lambda d: packing.best_fit_packing(d, path), None),
        "contaminated": (lambda d: decontam.contaminated(d, benchmark), None),
        "decontaminate": (lambda d: decontam.decontaminate(d, benchmark), None),
        "spelling": (spelling.spelling_variants, 1),
        "mixture": (mixing.mixture, len(ROWS)),
        "mixed_documents": (mixing.mixed_documents, None),
        "collocations": (lambda d: collocations.collocations(d, least=3), None),
    }


NAMES = ("chunks", "without_repeats", "quality", "accepted", "licenses", "secrets", "pii", "sanitise", "simhash", "one_of_each", "tokens", "packing", "contaminated", "decontaminate", "spelling", "mixture", "mixed_documents", "collocations")
KEEP_COLUMNS = {"without_repeats", "accepted", "sanitise", "one_of_each", "decontaminate", "mixed_documents"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, odd, labels, benchmark, forest, spark):
    make, n = cases(labels, benchmark, forest, spark)[name]
    got = make(odd)
    assert n is None or got.count() == n
    if name in KEEP_COLUMNS:
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert make(odd.limit(0)).count() == 0


def test_defined_results(odd, labels, benchmark, forest, spark):
    counts = {(r.doc_id, r.n_tokens > 0) for r in tokens.token_counts(odd, queries.tokenizer_path("piece_bpe_32k.model")).collect()}
    assert {(2, False), (3, False), (None, True)} <= counts
    groups = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert groups[2] == groups[3] == groups[4] == (0, 2)  # no words: fingerprint zero, one group
    kept = [r.doc_id for r in simhash.one_of_each(odd).collect()]
    assert kept.count(1) == 1 and 2 in kept and 3 not in kept and None in kept
    pieces = packing.best_fit_packing(odd, queries.tokenizer_path()).where("doc_id IN (2, 3)").collect()
    assert [(r.length, r.piece) for r in pieces] == [(1, 0), (1, 0)]
    assert {r.doc_id for r in decontam.contaminated(odd, benchmark).collect()} == {5}
    assert {r.doc_id for r in licenses.license_notices(odd).collect()} == {6}
    assert [r.predicted for r in secrets.secrets(odd, forest).where("doc_id = 7").collect()] == [1]
    spans = {r.doc_id: r.base for r in pii.personal_data(odd).collect()}
    assert len(spans[1]) == 1 and not spans[2] and not spans[3]
    clean = {r.doc_id: r.text for r in pii.sanitise(odd).collect()}
    assert clean[2] is None and clean[1] == "Write to [EMAIL] now"


def test_empty_side_tables(odd, spark):
    assert quality.accepted(odd, spark.createDataFrame([], "doc_id long, quality int")).count() == len(ROWS)
    assert decontam.decontaminate(odd, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    docs = odd.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(ROWS)


def test_pipeline_against_its_stages_by_hand(spark, sf_dir):
    """Each stage's decisions on the smallest tables, made again by the brute-force models."""
    import corpus_pipeline
    from test_operators import components_model, fingerprint_model

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "s").where("s >= 0.3")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scored.select("doc_id").collect()}
    rows = kept.select("doc_id", "text").collect()
    want = set(components_model([r.doc_id for r in rows], [fingerprint_model(r.text or "") for r in rows]).values())
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    assert {r.doc_id for r in single.select("doc_id").collect()} == want
    final = corpus_pipeline.run(spark, sf_dir).toPandas()
    hit = {r.doc_id for r in decontam.contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(final.doc_id) == want - hit
    assert final.groupby("sequence_id").length.sum().max() <= 2048
