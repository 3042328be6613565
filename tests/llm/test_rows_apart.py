"""Rows of a shared doc_id, or of none, are told apart by their texts."""

from __future__ import annotations

import random
import zlib

import pytest

from tessera.llm import bits, chunks, decontam, licenses
from tessera.llm.chunks import VERSIONS


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_clean_rows_stay_beside_contaminated_ones(spark):
    rng = random.Random(1)
    item = prose(rng, 30)
    dirty, clean = [f"{prose(rng, 20)} {item} {prose(rng, 9)}" for _ in range(2)], [prose(rng, 60) for _ in range(3)]
    rows = [(None, dirty[0]), (None, clean[0]), (5, dirty[1]), (5, clean[1]), (6, clean[2]), (7, dirty[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", decontam.F.lit("clash")).withColumn("item_id", decontam.F.lit(1))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, clean[0]), (5, clean[1]), (6, clean[2]), (None, None)}
    assert sorted(map(repr, decontam.contaminated(docs, benchmark).select("doc_id", "score").collect())) == sorted(map(repr, [spark.createDataFrame([(d, 1.0)], "doc_id long, score double").first() for d in (None, 5, 7)]))


def test_unlike_texts_of_one_short_digest(spark):
    """Two texts whose 24 bits of CRC32 are equal: the one without repeats stays whole."""
    rng = random.Random(2)
    passage = prose(rng, 120)
    repeats = f"{prose(rng, 80)} {passage} {prose(rng, 80)}"
    want = zlib.crc32(repeats.encode()) % VERSIONS
    head = prose(rng, 400).encode()
    state = zlib.crc32(head)
    tail = next(t for t in (b" %d" % i for i in range(200_000_000)) if zlib.crc32(t, state) % VERSIONS == want)
    innocent = (head + tail).decode()
    rows = [(None, repeats), (None, innocent), (1, f"{prose(rng, 30)} {passage} {prose(rng, 30)}")]
    got = {r.text for r in chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert innocent in got and repeats not in got and rows[2][1] in got


def test_license_rows_of_unlike_texts(spark):
    name, text = next(iter(licenses.TEMPLATES.items()))
    rows = [(None, f"a {text} b"), (None, f"c {text} d"), (3, f"e {text}"), (3, f"f f {text}"), (3, f"e {text}"), (None, "nothing")]
    got = sorted((str(r.doc_id), r.license, r.first_word) for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).where(f"license = '{name}'").collect())
    assert [g[0] for g in got] == ["3", "3", "None", "None"]


def test_common_ngrams_are_no_seeds(spark, monkeypatch):
    """Words around an n-gram make it common, copies don't; an item of common n-grams keeps its rarest."""
    monkeypatch.setattr(decontam, "LEAST_SEEDS", 4)
    rng = random.Random(3)
    copied, quoted = "one two three four five six seven eight", "alpha beta gamma delta"
    rows = [(i, f"{prose(rng, 5)} {copied} {prose(rng, 5)}") for i in range(60)] + [(100 + i, f"{prose(rng, 3)} {quoted} {prose(rng, 3)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = decontam.items_of(spark.createDataFrame([(1, copied), (2, f"{prose(rng, 8)} {quoted} {prose(rng, 8)}"), (3, quoted)], "item_id long, text string"))
    grams = decontam.item_grams(items, 3)
    seeds = decontam.rare_seeds(docs, grams, 3, rare=20, least=2).join(items, "item").groupBy("item_id").count().collect()
    # of 6, 18 and 2 n-grams: the two edges of the copied item stand beside many words
    assert {r.item_id: r["count"] for r in seeds} == {1: 4, 2: 16, 3: 2}


def test_bits_find_all_that_is_set(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(5000)]
    made = bits.bit_set(spark.createDataFrame([(v,) for v in values], "h long"), len(values))
    import numpy as np

    assert bits.is_set(made, np.array(values, np.int64).view(np.uint64)).all()
    others = np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64)
    assert bits.is_set(made, others).mean() < 0.03
    assert not bits.is_set(bits.bit_set(spark.createDataFrame([], "h long"), 0), others).any()


@pytest.mark.parametrize("n", [0, 1])
def test_tables_without_items(spark, n):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "x y")], "item_id long, text string").limit(n)
    assert decontam.contaminated(docs, benchmark).count() == 0 and decontam.decontaminate(docs, benchmark).count() == 1


def test_words_of_a_batch(monkeypatch):
    """Words by row as splitting gives them, over rows that touch, slices, and words longer than the stride."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import words

    rng = random.Random(6)
    texts = ["", "a", "ab cd", "cd-ab", " \t", "é,ß.x", "w" * 40 + " " + "w" * 41, "w" * 32 + "!" + "w" * 33] + ["".join(rng.choice("abé .,-\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want = [decontam.words_of(t) for t in texts]
    by_word: dict = {}
    for held in (1 << 22, 50):
        monkeypatch.setattr(words, "HELD_BYTES", held)
        for cut in (0, 5):
            got = [[] for _ in texts[cut:]]
            for low, hashes, rows in words.words_of_batch(pa.array(texts)[cut:]):
                for h, r in zip(hashes.tolist(), rows.tolist(), strict=True):
                    got[low + r].append(h)
            for own, hashed in zip(want[cut:], got, strict=True):
                assert len(own) == len(hashed)
                for w, h in zip(own, hashed, strict=True):
                    assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    at, made = words.grams(np.arange(6, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2]), 2)
    assert at.tolist() == [0, 1, 3] and len(set(made.tolist())) == 3
