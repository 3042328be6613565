"""Spelling variants, mixing and collocations against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bits, collocations, mixing, queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11: spelling variants ----------------------------------------------------------------------------


def variants_model(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = defaultdict(set)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
        for at in range(len(w)):
            shorter = w[:at] + w[at + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for words in by_length.values():
        coded = np.array([[ord(c) for c in w] for w in words])
        for i, w in enumerate(words):
            near[w] |= {words[j] for j in np.flatnonzero((coded != coded[i]).sum(axis=1) == 1)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_op11_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert variants(queries.op11_deletion_spelling(spark, sf_dir)) == variants_model(rows)


def test_op11_planted(spark, monkeypatch):
    """Chains of forms, runs of one letter, words beyond the carried length, long words, and edits at either end."""
    rng = random.Random(7)
    base = ["aaaaaaaa", "tttabbbaa", "überprüfung", "ÀÿÀÿÀÿÀÿ", "x" * 70, "".join(rng.choice("abc") for _ in range(64)), "".join(rng.choice("abcd") for _ in range(3000))]
    words = []
    for w in base:
        words += [w] * 2000
        for _ in range(12):
            at = rng.randrange(len(w))
            edited = rng.choice([w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "z" + w[at + 1 :]])
            words += [edited] * rng.choice([2, 15, 200])
            at = rng.randrange(len(edited))
            words += [edited[:at] + "q" + edited[at:], edited[:at] + edited[at + 1 :]] * rng.choice([1, 2])
    rng.shuffle(words)
    rows = [(i if i % 5 else None, " ".join(words[i::400])) for i in range(400)] + [(1, None), (None, None), (2, ""), (3, "1234 -- ,")]
    monkeypatch.setattr(spelling, "HELD_POINTS", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", spelling.F.lit(1)).withColumn("n", spelling.F.lit("clash"))
    got = variants(spelling.spelling_variants(df))
    assert got == variants_model(rows)
    assert any(form and root != form for form, root, *_ in got.values())
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_op11_collisions_are_told_apart():
    """Rows of one key whose strings differ, as if the hash had collided."""
    got = list(spelling.near_of_key([(-1, "kettles", 9), (0, "ykettles", 3), (2, "another", 5), (2, "anyther", 70), (2, "unrelated", 8), (3, "anotherz", 4)]))
    assert sorted(got) == [("another", 1, "anyther", 70), ("anyther", 1, "another", 5), ("kettles", 1, "ykettles", 3), ("ykettles", 1, "kettles", 9)]


def test_op11_keys_are_those_of_the_strings():
    words = ["abcdefg", "bcdefg", "zzabcdefgh", "é" * 9]
    which, at, keys = spelling.deletion_keys(words)
    left = [words[w] if a < 0 else words[w][:a] + words[w][a + 1 :] for w, a in zip(which, at, strict=True)]
    assert len(set(keys.tolist())) == len(set(left)) and len(dict(zip(left, keys.tolist(), strict=True))) == len(set(zip(left, keys.tolist(), strict=True)))


# --- 12: mixing ---------------------------------------------------------------------------------------


def targets_model(size: dict, weight: dict, share=1.5, most=2.0):
    goal, open_, got = share * sum(size.values()), set(size), {}
    while open_:
        level = (goal - sum(got.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * size[s]}
        if not over:
            return got | {s: level * weight[s] for s in open_}
        got |= {s: most * size[s] for s in over}
        open_ -= over
    return got


def check_mix(rows, sources, tolerance):
    """``rows``: (source, size, source_size, target, taken) of each document."""
    size, target, taken = Counter(), {}, Counter()
    for s, n, source_size, goal, took in rows:
        size[s] += n
        taken[s] += took
        target[s] = goal
        assert 0 <= took <= 2 * n and (n == 0 or took % n == 0)
    for s, _, source_size, _, _ in rows:
        assert source_size == size[s]
    ranked = sorted(size, key=lambda s: (s is None, s or ""))
    want = targets_model(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(ranked)})
    assert set(size) == set(sources)
    for s in size:
        assert abs(target[s] - want[s]) <= 1e-9 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= tolerance(s), (s, taken[s], target[s])


def test_op12_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    source = {r.doc_id: r.source for r in docs}
    model = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in docs}
    got = queries.op12_pivotal_mixing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted(model.items())
    longest = Counter()
    for d, n in model.items():
        longest[source[d]] = max(longest[source[d]], n)
    check_mix([(source[r.doc_id], r["size"], r.source_size, r.target, r.taken) for r in got], set(source.values()), lambda s: longest[s])
    again = queries.op12_pivotal_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def mixed_rows(rng, n=3000):
    rows = [(i, rng.choice(["b", "b", "b", "a", None, "", "c"]), " ".join("w" for _ in range(rng.choice([1, 3, 10, 40])))) for i in range(n)]
    return rows + [(None, "a", None), (None, "d", ""), (7, "b", "w " * 5000), (7, "b", "w " * 5000), (8, "e", " x y")]


def test_op12_tree_means_and_reruns(spark, monkeypatch):
    """Several levels of the tree: sums stay near their targets, and nothing depends on how rows are dealt."""
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "WAYS", 4)
    rows = mixed_rows(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", mixing.F.lit(1)).withColumn("leaf", mixing.F.lit("clash"))
    got = [(r.source, r["size"], r.source_size, r.target, r.taken, r.doc_id) for r in mixing.mixture(df).collect()]
    assert len(got) == len(rows)
    check_mix([g[:5] for g in got], {r[1] for r in rows}, lambda s: 7 if s in ("a", "b", "c", "", None) else 2)
    again = [(r.source, r["size"], r.source_size, r.target, r.taken, r.doc_id) for r in mixing.mixture(df.repartition(7)).collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(again, key=key)
    other = [(r.doc_id, r.taken) for r in mixing.mixture(df, seed=1).collect()]
    assert sorted(map(repr, other)) != sorted(repr((g[5], g[4])) for g in got)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(g[4] // g[1] for g in got if g[1])
    assert mixing.mixture(df.limit(0)).count() == 0


def test_op12_means_of_documents():
    """Over many seeds a document is taken as often as its probability says."""
    rows, taken, runs = [((i, i, 1 + i % 7), 0.3) for i in range(20)], Counter(), 4000
    for seed in range(runs):
        pivot = mixing.Pivot(seed)
        for row, p in rows:
            for own, up in pivot.meet(row, p):
                taken[own[0]] += up
        if pivot.open:
            own, p = pivot.open
            taken[own[0]] += pivot.drawn(*own, p) < p
    assert all(abs(taken[i] / runs - 0.3) < 0.035 for i in range(20))


def test_op12_given_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 5)) for i in range(1000)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    got = {r.source: (r.target, r.taken) for r in mixing.mixture(df, weights, share=0.5).groupBy("source").agg(mixing.F.max("target").alias("target"), mixing.F.sum("taken").alias("taken")).collect()}
    assert got["b"] == (0.0, 0) and abs(got["a"][1] - got["a"][0]) <= 5


# --- 13: collocations ---------------------------------------------------------------------------------


def collocations_model(rows, least=30, reported=2000):
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {g: n for g, n in counts.items() if n >= least}
    out = defaultdict(list)
    longer = Counter()
    for (lang, words), n in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longer[lang, words[i : i + k]] = max(longer[lang, words[i : i + k]], n)
    for (lang, words), a in frequent.items():
        if len(words) < 2 or ((lang, words) in longer and 100 * longer[lang, words] >= 80 * a):
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:reported])}


def found(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_op13_whole_table(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    got = found(queries.op13_apriori_collocations(spark, sf_dir))
    assert got == collocations_model(rows)


@pytest.mark.parametrize("most_bits", [1 << 16, 64])
def test_op13_planted(spark, monkeypatch, most_bits):
    """Few words, so that all lengths occur often; small blocks; a bit set that is all ones prunes nothing and changes nothing."""
    rng = random.Random(5)
    words = ["Of", "the", "a b", "é", "x" * 300, "united", "states", "of", "\x00", "\x1c"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", "!?"]) for _ in range(rng.randint(0, 60)))

    rows = [(rng.choice(["en", "en", "en", None, "und", ""]), text()) for _ in range(400)] + [(None, None), ("en", ""), ("de", "the the the the the the " * 40), ("en", "the " * 30_000)]
    rows += [("en", "so be it. " * 29), ("fr", "so be it. " * 30)]
    monkeypatch.setattr(collocations, "HELD_BYTES", 5000)
    monkeypatch.setattr(collocations, "ROWS", 7)
    monkeypatch.setattr(bits, "LEAST_BITS", 64)
    real = collocations.bit_set
    monkeypatch.setattr(collocations, "bit_set", lambda grams, n: real(grams, n, most_bits))
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", collocations.F.lit(1)).withColumn("phrase", collocations.F.lit("clash")).repartition(3)
    got = found(collocations.collocations(df, reported=40))
    assert got == collocations_model(rows, reported=40)
    assert {g[2] for g in got if g[0] == "fr"} == {"so be it"}
    assert collocations.collocations(df.limit(0)).count() == 0


def test_op13_hashes_that_collide_are_told_apart():
    first, second = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 3, 1, 3], np.uint64)
    at, n = collocations.told_apart(first, second)
    assert sorted(zip(first[at].tolist(), second[at].tolist(), n.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (7, 3, 2)]


def test_op13_products_beyond_64_bits(spark):
    n = 9 * 10**12
    counts = spark.createDataFrame([("en", "a", n + 7), ("en", "b", n), ("en", "a b", n)], "lang string, phrase string, n long")
    row = collocations.cut_scores(counts.where("phrase = 'a b'"), counts).first()
    assert (row.score, row.l, row.r) == (2000000 * n // (2 * n + 7), n + 7, n)
