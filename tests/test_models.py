"""Operators that SQL can't express, against small models written apart from them."""

from __future__ import annotations

import hashlib
import json
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import docs, evaluation, fulltext, ingestion, operations, retrieval, trees
from tessera.sources import archives


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


# --- evidence -----------------------------------------------------------------------------------------


def evidence_model(items, tokens, most, item_tokens):
    """What is used is added up item by item, and the room is what that leaves: sums in another order round otherwise."""
    kept, used = [], 0.0
    for position, lines in items:
        if len(kept) >= most:
            return kept
        left, n = tokens - used, 0
        while n < len(lines) and len("\n".join(lines[: n + 1])) / 3.5 <= min(left, item_tokens):
            n += 1
        if n == 0:
            continue
        kept.append((position, n))
        if n < len(lines) and left <= item_tokens:
            return kept
        used += len("\n".join(lines[:n])) / 3.5
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=9), min_size=1, max_size=5), max_size=8), st.integers(1, 40), st.integers(1, 5), st.integers(1, 12))
@example([["", "a", "a", "aaaaaa", "aaaaaa"], ["aa", "aaaaa", "aaaaaaaaa"], ["a", "aa", "aa", "aaaaaaaaa", "aaaaaaaaa"]], 18, 3, 8)
def test_evidence_budget(items, tokens, most, item_tokens):
    numbered = list(enumerate(items))
    assert retrieval.take_evidence(numbered, tokens, most, item_tokens) == evidence_model(numbered, tokens, most, item_tokens)


def test_build_evidence_labels_and_digests(spark):
    files = rows(spark, "path string, content string", ("a", "one\ntwo\nthree\n"), ("b", "x" * 100))
    ranked = rows(spark, "question_id int, place int, path string, start_line int, end_line int", (1, 1, "a", 2, 9), (1, 2, "b", 1, 1), (1, 3, "a", 1, 1), (2, 1, "b", 5, 6))
    got = retrieval.build_evidence(ranked, files, tokens=10, item_tokens=8).orderBy("rank").collect()
    assert [(r.label, r.path, r.start_line, r.end_line, r.excerpt) for r in got] == [("E1", "a", 2, 3, "two\nthree"), ("E2", "a", 1, 1, "one")]


# --- ranges and fusion --------------------------------------------------------------------------------


def test_ranges_merge_when_they_touch(spark):
    r = rows(spark, "path string, start_line int, end_line int, place int", ("a", 1, 5, 3), ("a", 6, 8, 1), ("a", 10, 12, 2), ("a", 2, 3, 9), ("b", 1, 1, 4))
    got = {tuple(x) for x in retrieval.merge_ranges(r, "path").collect()}
    assert got == {("a", 1, 8, 1), ("a", 10, 12, 2), ("b", 1, 1, 4)}


def test_fusion_ignores_repeats_but_counts_their_ranks(spark):
    r = rows(spark, "list_no int, rank int, item string", (0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (1, 1, "b"), (1, 2, "c"))
    got = {x.item: (round(x.score, 9), x.place) for x in retrieval.reciprocal_rank_fusion(r).collect()}
    assert got == {"b": (round(1 / 63 + 1 / 61, 9), 1), "a": (round(1 / 61, 9), 2), "c": (round(1 / 62, 9), 3)}


def test_windows_of_lines(spark):
    for n, want in ((0, []), (1, [(1, 1)]), (60, [(1, 60)]), (61, [(1, 60), (51, 61)]), (110, [(1, 60), (51, 110)]), (111, [(1, 60), (51, 110), (101, 111)])):
        f = rows(spark, "path string, content string", ("a", "x\n" * n))
        assert [(r.start_line, r.end_line) for r in retrieval.window_chunks(f, 60, 10, "path").orderBy("start_line").collect()] == want


# --- text ---------------------------------------------------------------------------------------------


def test_identifiers(spark):
    cases = {"getUserById": "get user by id getuserbyid", "HTTPServer2": "http server 2 httpserver2", "user_id": "user id userid", "__init__": "init", "café": "café", "": ""}
    df = rows(spark, "t string", *[(k,) for k in cases])
    got = {r.t: " ".join(r.x) for r in df.select("t", X.split_identifiers("t").alias("x")).collect()}
    assert got == cases


def test_headings_fences_and_long_sections():
    content = "intro\n\n# A\ntext\n## B\n```\n# not a heading\n\n```\n# C\n# D\nlast"
    got = [(a, b, p) for a, b, p, _ in ingestion.heading_sections(content)]
    assert got == [(1, 1, ""), (3, 4, "A"), (5, 9, "A > B"), (11, 12, "D")]
    long = "# T\n" + "\n".join("word " * 10 for _ in range(40))
    parts = ingestion.heading_sections(long, 200)
    assert "\n".join(t for *_, t in parts) == long and all(len(t) <= 200 for *_, t in parts)


def test_embedding_is_of_unit_length():
    v = ingestion.hash_embedding("One two two", 16)
    assert abs(sum(x * x for x in v) - 1) < 1e-12
    for text in ("", "...", "\n"):  # without words: the text itself, hashed
        at = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % 16
        assert ingestion.hash_embedding(text, 16) == [float(i == at) for i in range(16)]


def test_embeddings_query(spark, sf_dir):
    from tessera.plans import ingestion as plans

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for r in plans.hash_embeddings(spark, sf_dir).collect():
        want = [0.0] * 64
        for word in re.findall(r"\w+", texts[r.item_id].lower()) or [texts[r.item_id]]:
            want[int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") % 64] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert all(abs(x - y / norm) < 1e-12 for x, y in zip(r.embedding, want, strict=True))


def test_vectors_without_a_direction_take_no_part(spark):
    df = rows(spark, "vec_id int, embedding array<double>", (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]))
    assert [(r.vec_id, r.distance) for r in retrieval.exact_nearest(df, [3.0, 0.0], 9).collect()] == [(2, 0.0), (6, 1.0)]
    assert retrieval.exact_nearest(df, [0.0, 0.0], 9).count() == 0


def test_members_of_other_kinds_and_encodings(spark):
    df = rows(spark, "member_no int, path string, kind string, raw binary", (1, "dev", "device", None), (2, "a.txt", "file", bytearray(b"ok")), (3, "b.txt", "file", bytearray(b"\xff\xfe")), (4, "c.txt", "file", None), (5, "l", "link", None), (6, "d.bin", "file", bytearray(b"a\0\xff")))
    got = ingestion.classify(df.withColumn("content", F.col("raw").cast("string"))).orderBy("member_no").collect()
    assert [r.reason for r in got] == ["unsafe_path", None, "encoding", "too_large", "link", "binary"]


# --- trees --------------------------------------------------------------------------------------------


def test_hunks():
    (h,) = trees.hunks_of("a\nb\nc\n", "a\nx\nc\n")
    assert h == (1, 3, 1, 3, 1, 1, " a\n-b\n+x\n c")
    (h,) = trees.hunks_of("", "n\n")
    assert h[:4] == (None, None, 1, 1)
    assert trees.hunks_of("a\n", "a\n") == [] and trees.hunks_of("", "") == []


lines_ = st.lists(st.sampled_from("abcd"), max_size=25).map(lambda x: "".join(f"{line}\n" for line in x))


@settings(max_examples=200, deadline=None)
@given(lines_, lines_, st.integers(1, 3))
def test_hunks_put_back_give_the_other_text(before, after, context):
    """Each hunk's own lines are where it says; put in for each other they make one text of the other."""
    old, new = before.split("\n")[:-1], after.split("\n")[:-1]
    found = trees.hunks_of(before, after, context)
    made, upto = [], 0
    for a, b, c, d, removed, added, text in found:
        body = text.split("\n")
        assert [x[1:] for x in body if x[0] != "+"] == (old[a - 1 : b] if a else []) and [x[1:] for x in body if x[0] != "-"] == (new[c - 1 : d] if c else [])
        assert removed == sum(x[0] == "-" for x in body) and added == sum(x[0] == "+" for x in body) and removed + added
        start = a - 1 if a else upto + (c - 1 - len(made) - 0 if c else 0)
        made += old[upto:start] + (new[c - 1 : d] if c else [])
        upto = b if a else start
        outer = [x[0] for x in body]
        assert len("".join(outer)) - len("".join(outer).lstrip()) <= context and len("".join(outer)) - len("".join(outer).rstrip()) <= context
    assert made + old[upto:] == new


def test_hunks_query(spark, sf_dir):
    from tessera.plans import trees as plans

    texts = {r.path: r for r in plans.changed_texts(spark, sf_dir).collect()}
    got = plans.diff_hunks(spark, sf_dir).collect()
    for r in got:
        body = r.text.split("\n")
        assert "\n".join(x[1:] for x in body if x[0] != "-") in texts[r.path].after and "\n".join(x[1:] for x in body if x[0] != "+") in texts[r.path].before
    assert {r.path for r in got} == {p for p, r in texts.items() if r.before != r.after}


def test_selection_passes_over_what_does_not_fit(spark):
    df = rows(spark, "review int, place int, files int, tokens double", (1, 1, 1, 6.0), (1, 2, 1, 7.0), (1, 3, 1, 4.0), (1, 4, 1, 0.0), (2, 1, 1, 99.0))
    got = trees.select_within(df, {"files": 3, "tokens": 10.0}, "review").select("review", "place").collect()
    assert {tuple(r) for r in got} == {(1, 1), (1, 3), (1, 4)}


def test_renames_pair_once_and_never_when_empty(spark):
    e = trees.EMPTY_SHA256
    schema = "path string, change string, base_sha256 string, head_sha256 string"
    c = rows(spark, schema, ("o1", "removed", "s", None), ("o2", "removed", "s", None), ("n1", "added", None, "s"), ("n2", "added", None, "t"), ("o3", "removed", e, None), ("n3", "added", None, e))
    hints = rows(spark, "old string, new string", ("o1", "n2"), ("o1", "n3"), ("gone", "n1"))
    assert {tuple(r) for r in trees.pair_renames(c, hints).collect()} == {("o1", "n2"), ("o2", "n1")}


# --- operations ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25), st.integers(0, 4), st.integers(1, 9))
def test_limiter_counts_allowed_calls_only(gaps, limit, seconds):
    at, allowed, recent = 0, [], []
    for gap in gaps:
        at += gap * 500_000
        want = sum(t > at - seconds * 1_000_000 for t in allowed) < limit
        got, wait, recent = operations.limiter_step(recent, at, limit, seconds)
        assert got == want
        if want:
            allowed.append(at)
        else:
            assert wait >= 1
            later = at + wait * 1_000_000
            assert limit == 0 or sum(t > later - seconds * 1_000_000 for t in allowed) < limit


def test_access_keeps_the_first_loss():
    state, since = "active", None
    for at, kind in enumerate(["pause", "loss", "loss", "resume", "restore"]):
        state, since = operations.access_step(state, since, kind, at)
        assert (state, since) == [("paused", 0), ("access_lost", 1), ("access_lost", 1), ("access_lost", 1), ("active", None)][at]


# --- sources ------------------------------------------------------------------------------------------


def test_json_lines_are_checked(spark, tmp_path):
    from pyspark.sql import types as T

    lines = [json.dumps({"id": "a", "n": 1}), json.dumps({"id": "b"}), "{broken", json.dumps({"id": "c", "n": 1}), json.dumps({"id": "c", "n": 2})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.LongType(), False)])
    good, bad = archives.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema, "id")
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert {(r.id, r.problem) for r in bad.collect()} == {("b", "missing value"), (None, "unreadable"), ("c", "repeated key")}


def test_reports(spark, tmp_path):
    df = rows(spark, "a int, b string", (1, "x|y"))
    archives.write_reports(df, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/markdown").first()[0] == "| 1 | x\\|y |"
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 1


def test_review_selection_query(spark, sf_dir):
    from tessera.plans import trees as plans

    sizes = plans.sizes(spark, sf_dir).collect()
    kind = lambda p: 2 if p.lower().endswith((".md", ".mdx", ".txt")) else 1 if "/tests/" in f"/{p}" else 0
    want, used = set(), {}
    for r in sorted(sizes, key=lambda r: (f"{kind(r.path)}:{r.path}")):
        own = used.setdefault(r.path.split("/")[0], [0, 0, 0, 0.0])
        more = [1, r.additions + r.deletions, r.hunks, r.tokens]
        if all(x + y <= most for x, y, most in zip(own, more, (100, 2000, 80, 40_000), strict=True)):
            want.add(r.path)
            own[:] = [x + y for x, y in zip(own, more, strict=True)]
    assert {r.path for r in plans.review_selection(spark, sf_dir).collect()} == want


def test_set_digest_tells_sets_apart(spark):
    many = [(str(i), str(i % 7)) for i in range(500)]
    one = lambda values, **options: evaluation.set_digest(rows(spark, "n string, c string", *values), "n", "c", **options).first().digest
    assert one(many, fan=4) == one(many[::-1], fan=4) != one([*many[:-1], ("499", "x")], fan=4)
    assert one(many, fan=4) != one(many[:-1], fan=4)
    assert evaluation.set_digest(rows(spark, "n string, c string", ("a", "b")).limit(0), "n", "c").first().digest == hashlib.sha256(b"").hexdigest()


def test_set_digest_does_not_depend_on_order(spark):
    a = rows(spark, "n string, c string", ("x", "1"), ("y", "2"))
    b = rows(spark, "n string, c string", ("y", "2"), ("x", "1"))
    assert evaluation.set_digest(a, "n", "c").first() == evaluation.set_digest(b, "n", "c").first()


def test_overlapping_hits_give_way_to_better_ones(spark):
    h = rows(spark, "path string, start_line int, end_line int, place int", ("a", 1, 60, 1), ("a", 51, 110, 2), ("b", 51, 110, 3), ("a", 111, 150, 4), ("c", 1, 1, 5))
    got = {(r.path, r.start_line) for r in docs.without_overlaps(h, 3).collect()}
    assert got == {("a", 1), ("b", 51), ("a", 111)}


def test_docs_search_is_degraded_without_a_vector(spark):
    files = rows(spark, "path string, content string", ("a", "license text\nmore"), ("b", "other words"))
    chunks = ingestion.with_embeddings(retrieval.window_chunks(files, 60, 10, "path"), 8)
    unit, question = ("path", "start_line", "end_line"), rows(spark, "question_id int, question string", (1, "what license"))
    index, terms = fulltext.full_text_index(chunks, *unit), retrieval.query_terms(question)
    keywords = docs.search_docs(index, terms, None, None, 5).collect()
    assert [(r.path, r.degraded) for r in keywords] == [("a", True)]
    asked = rows(spark, "question_id int, question string", (1, "other words"))
    both = docs.search_docs(index, terms, chunks, ingestion.with_embeddings(asked, 8, "question"), 5).orderBy("place").collect()
    assert {r.path for r in both} == {"a", "b"} and not both[0].degraded


def test_tokens_of_questions(spark):
    q = rows(spark, "question_id int, question string", (1, "What does ./getUser.py do with user_id, HTTPServer and well-known Getuser.PY things v2?"))
    got = [(r.token, r.is_identifier) for r in retrieval.identifier_tokens(q).orderBy("at").collect()]
    assert got == [("getUser.py", True), ("user_id", True), ("HTTPServer", True), ("well", False), ("known", False), ("things", False), ("v2", True)]


def test_paths_match_by_form_and_case(spark):
    files = rows(spark, "path string", ("src/app/Main.py",), ("main.py",))
    q = rows(spark, "question_id int, question string", (1, "app/Main.py"), (2, "main.py"), (3, "Main"))
    got = {(r.question_id, r.path): r.score for r in retrieval.exact_candidates(retrieval.identifier_tokens(q), retrieval.path_forms(files), "path").collect()}
    assert got == {(1, "src/app/Main.py"): 0.95, (2, "src/app/Main.py"): 0.72, (2, "main.py"): 1.0, (3, "src/app/Main.py"): 0.4, (3, "main.py"): 0.32}


def markdown_model(text, leading=False):
    """The same rules, word by word: what stands in backticks of one length is left as it is."""
    flat, out, at = " ".join(text.split()), "", 0
    while at < len(flat):
        m = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)").search(flat, at)
        part = flat[at : m.start()] if m else flat[at:]
        part = part.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        part = "".join("\\" + c if c in "\\`[]" else c for c in part)
        out += re.sub(r"(?i)(?<![\w@])@[a-z0-9][\w-]*(?:/[\w.-]+)?|#\d+\b|\bGH-\d+\b", lambda m: f"`{m[0]}`", part) + (m[0] if m else "")
        at = m.end() if m else len(flat)
    if leading and out[:1] and out[0] in "#>+*=|~-":
        return "\\" + out
    return re.sub(r"^(\d+)([.)])", r"\1\\\2", out) if leading else out


def test_markdown_does_nothing(spark):
    cases = ["plain", "a <b> & [link](x)", "see `@me` and @me/team or #12, GH-7 x@y.z", "``a`b`` stray ` tick", "# title", "1. item", "- list", "a\n\tb  c", "", "\\d", "`", "`open [x]", "~~~", "2) x #3 `#4`"]
    got = {r.t: (r.a, r.b) for r in rows(spark, "t string", *[(c,) for c in cases]).select("t", X.neutral_markdown("t").alias("a"), X.neutral_markdown("t", True).alias("b")).collect()}
    assert got == {c: (markdown_model(c), markdown_model(c, True)) for c in cases}


def test_neutral_markdown_query(spark, sf_dir):
    from tessera.plans import retrieval as plans

    texts = {r.file_id: r.content for r in plans.files(spark, sf_dir).collect()}
    got = {r.file_id: r.line for r in plans.neutral_markdown(spark, sf_dir).collect()}
    assert got == {i: markdown_model(t, True) for i, t in texts.items()}


def test_word_similarity(spark):
    def grams(t):
        return [f"  {w} "[i : i + 3] for w in re.findall(r"[a-z0-9]+", t.lower()) for i in range(len(w) + 1)]

    def model(query, text):
        q, g = set(grams(query)), grams(text)
        return max([len(q & set(g[i : j + 1])) / len(q | set(g[i : j + 1])) for i in range(len(g)) for j in range(i, len(g))], default=0.0)

    cases = [("word", "two words"), ("get_user", "src/api/get_user_by_id.py"), ("main", "docs/remain.md"), ("abc", ""), ("doc 12", "src1/en/doc_12.txt"), ("zzz", "src/a.py")]
    for query, text in cases:
        want = model(query, text)
        got = rows(spark, "t string", (text,)).select(X.word_similarity(query, "t", 0.5).alias("s")).first().s
        assert abs((got or 0.0) - (want if want >= 0.5 else 0.0)) < 1e-12, (query, text)


def lines_of(text):
    rows = text.split("\n")
    return rows[:-1] if rows[-1] == "" else rows


def test_search_docs_query(spark, sf_dir):
    """Keyword and vector ranks of every window, made again one window at a time."""
    from tessera.plans import retrieval as plans

    question = "bleed reaning license heating"
    asked = {(r.term, r.prefix) for r in retrieval.query_terms(rows(spark, "question_id int, question string", (1, question))).collect()}
    chunks = retrieval.window_chunks(plans.files(spark, sf_dir), 60, 10, "path").select("path", "start_line", "end_line", "text", X.split_identifiers("text").alias("terms")).collect()
    unit = lambda r: (r.path, r.start_line, r.end_line)
    score = {unit(r): sum(any(t == a or prefix and t.startswith(a) for a, prefix in asked) for t in r.terms) for r in chunks}
    keywords = sorted((u for u in score if score[u]), key=lambda u: (-score[u], u))[:20]
    vector = ingestion.hash_embedding(question, 64)
    # vectors are of unit length
    away = {unit(r): 1 - sum(x * y for x, y in zip(ingestion.hash_embedding(r.text, 64), vector, strict=True)) for r in chunks}
    near = sorted(away, key=lambda u: (round(away[u], 12), u))[:20]
    fused = {}
    for no, found in enumerate((keywords, near)):
        for rank, u in enumerate(found, 1):
            total, first = fused.get(u, (0.0, (no, rank)))
            fused[u] = (total + 1 / (60 + rank), first)
    kept = []
    for u in sorted(fused, key=lambda u: (-round(fused[u][0], 12), fused[u][1])):
        if len(kept) < 20 and not any(k[0] == u[0] and k[1] <= u[2] and u[1] <= k[2] for k in kept):
            kept.append(u)
    got = plans.search_docs(spark, sf_dir).orderBy("place").collect()
    assert [unit(r) for r in got] == kept and not any(r.degraded for r in got)


def test_heading_chunks_query(spark, sf_dir):
    """No line that isn't blank is lost or told twice."""
    from tessera.plans import ingestion as plans

    texts = {r.path: "# " + r.content for r in plans.files(spark, sf_dir).collect()}
    told = {}
    for r in plans.heading_chunks(spark, sf_dir).collect():
        own = texts[r.path].split("\n")[r.start_line - 1 : r.end_line]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == r.text_sha256
        told.setdefault(r.path, []).extend(range(r.start_line, r.end_line + 1))
    for path, numbers in told.items():
        assert len(numbers) == len(set(numbers))
        missing = [x for n, x in enumerate(texts[path].split("\n"), 1) if n not in set(numbers) and x.strip()]
        assert all(re.match(r" {0,3}#{1,6}([ \t]|$)", x) for x in missing)


def test_excerpts_around_names(spark):
    body = "\n".join(f"line {i}" for i in range(1, 101))
    files = rows(spark, "path string, content string", ("near", body.replace("line 20", "call getUser(x)").replace("line 25", "getUser_2 getUser")), ("far", body.replace("line 3\n", "getUser\n").replace("line 90", "getUser")), ("none", body), ("short", "a\nb"), ("empty", ""), ("unknown", None))
    chosen = rows(spark, "k int, path string", *[(1, p) for p in ("near", "far", "none", "short", "empty", "unknown", "absent")], (2, "near"))
    names = rows(spark, "k int, name string", (1, "getUser"), (1, "getUser"), (2, "getUser_2"), (2, None))
    got = {(r.k, r.path): (r.start_line, r.end_line) for r in trees.excerpts(chosen, files, names, "k").collect()}
    # an excerpt whose matches are far apart ends after forty lines
    assert got == {(1, "near"): (14, 31), (1, "far"): (1, 40), (1, "none"): (1, 13), (1, "short"): (1, 2), (2, "near"): (19, 31)}
    assert trees.excerpts(chosen.limit(0), files, names, "k").count() == 0
    whole = trees.excerpts(chosen.where("path = 'short'"), files, names, "k").first()
    assert whole.excerpt == "a\nb"


def test_useful_names(spark):
    names = rows(spark, "k int, position int, name string", (1, 3, "loadUser"), (1, 1, "Main"), (1, 2, "abc"), (1, 9, "loadUser"), (1, 0, None), (1, 4, "saveUser"), (2, 0, "test"))
    assert [(r.k, r.name, r.place) for r in trees.useful_names(names, "k").orderBy("k", "place").collect()] == [(1, "loadUser", 1), (1, "saveUser", 2)]
    assert trees.useful_names(names, "k", most=1).count() == 1


def test_labels_of_a_review(spark):
    made = rows(spark, "k int, path string, hunk int, added int, removed int, after_start int, after_end int, before_start int, before_end int, tokens double", (1, "b", 0, 1, 1, 5, 6, 7, 8, 10.0), (1, "a", 1, 0, 2, None, None, 3, 4, 10.0), (1, "a", 0, 2, 0, 1, 2, None, None, 10.0))
    context = rows(spark, "k int, place int, source_type string, path string, start_line int, end_line int, tokens double", (1, 1, "reference", "c", 1, 9, 30.0), (1, 2, "test", "d", 1, 9, 41.0), (1, 3, "test", "e", 1, 9, 0.0), (2, 1, "test", "f", 1, 9, 100.0))
    got = sorted((r.k, r["rank"], r.label, r.side, r.path) for r in trees.labelled_evidence(made, context, 100.0, "k").collect())
    # the second context item runs over the budget, and all after it goes with it; a review without hunks has its whole budget
    assert got == [(1, 1, "E1", "after", "a"), (1, 2, "E2", "before", "a"), (1, 3, "E3", "after", "b"), (1, 4, "E4", "before", "b"), (1, 5, "E5", "after", "c"), (2, 1, "E1", "after", "f")]
    assert trees.labelled_evidence(made, context, 100.0, "k", most=4).where("k = 1").count() == 4


def test_faults_of_citations(spark):
    points = rows(spark, "k int, position int, cited array<string>", (1, 1, ["E1"]), (1, 2, ["E2"]), (1, 3, ["E9", "E1", "E8"]), (1, 4, []), (1, 5, None), (2, 1, ["E1"]))
    evidence = rows(spark, "k int, label string, is_change boolean", (1, "E1", True), (1, "E2", False), (1, "E2", False))
    got = {(r.k, r.position): (r.unknown, r.no_change) for r in evaluation.citation_faults(points, evidence, "k").collect()}
    assert got == {(1, 2): ([], True), (1, 3): (["E9", "E8"], False), (1, 4): ([], True), (1, 5): ([], True), (2, 1): (["E1"], True)}


def test_review_results_query(spark, sf_dir):
    """Each review's result made again from its rows."""
    from tessera.plans import evaluation as plans
    from tessera.sources.tables import lines_once, table

    lines = {}
    for r in lines_once(spark, sf_dir).collect():
        lines.setdefault(r.review, []).append(r)
    got = {r.review: json.loads(r.result) for r in plans.review_results(spark, sf_dir).collect()}
    rank = {"high": 0, "medium": 1, "low": 2}
    for o in table(spark, sf_dir, "orders").collect():
        own = sorted(lines.get(o.o_orderkey, []), key=lambda r: r.n)
        risks = [{"severity": "high" if r.q > 40 else "medium" if r.q > 20 else "low", "title": f"line {r.n}", "origin": "model", "path": None, "at": r.n} for r in own if r.pk % 3]
        risks += [{"severity": "high", "title": "Credential file changed", "origin": "rule", "path": f".env{r.n}", "at": None} for r in own if r.pk % 7 == 0]
        risks = [{"id": f"R{i}", **r} for i, r in enumerate(sorted(risks, key=lambda r: rank[r["severity"]]), 1)]
        ids = {r["at"]: r["id"] for r in risks if r["at"]}
        names = {name: f"p{r.n}" for r in own if r.n % 2 for name in (f"p{r.n}", f"old{r.n}")}
        items = []
        for r in own:
            paths = list(dict.fromkeys(names[p] for p in ([f"p{r.n}", f"p{r.n + 1}", f"old{r.n}"] if r.sk % 2 == 0 else []) if p in names))
            items.append({"text": f"line {r.n}", "paths": paths, "risk_ids": list(dict.fromkeys(ids[i] for i in (r.n + 1, 1) if i in ids))})
        kept = [i for i in items if i["paths"] or i["risk_ids"]]
        areas = {}
        for r in own:
            areas.setdefault(f"area{r.sk % 3}", []).append(f"line {r.n}")
        assert got[o.o_orderkey] == {
            "overall_risk": {"level": risks[0]["severity"] if risks else "none", "partial": o.o_orderstatus == "P"}, "overview": f"Order {o.o_orderkey}", "summary": [{"area": a, "points": p} for a, p in areas.items()],
            "risks": [{k: v for k, v in r.items() if k != "at"} for r in risks], "checklist": kept, "coverage": {"changed_files": o.o_orderkey % 9, "reviewed_files": len(set(names.values()))},
            "omitted_items": o.o_orderkey % 3 + len(items) - len(kept),
        }, o.o_orderkey


def test_positions_after_rows_went(spark):
    items = rows(spark, "k int, item int, indexes array<int>", (1, 1, [0, 2, 3]), (1, 2, [1]), (1, 3, None), (2, 1, [0, 0]))
    kept = rows(spark, "k int, position int", (1, 0), (1, 3), (2, 0))
    got = {(r.k, r.item): r.indexes for r in evaluation.renumbered(items, kept, "k").collect()}
    assert got == {(1, 1): [0, 1], (1, 2): [], (1, 3): [], (2, 1): [0, 0]}


def test_a_hot_name_gives_its_first_units_to_the_questions(spark):
    """A name that all files declare is joined with the questions for as many units as they can take, and the candidates stay those of all pairs."""
    forms = [(f"p{i:03d}", form, w) for i in range(90) for form, w in (("Heat", 0.9), ("heat" if i % 2 else "HEAT", 1.0), ("Heat", 0.8))] + [("p500", "other", 1.0), ("p501", "Other", 0.8)] * 2
    tokens = [(q, at, t, t == "HEAT") for q in range(6) for at, t in enumerate((("Heat", "other"), ("HEAT",), ("other", "heat"))[q % 3])]
    f = spark.createDataFrame(forms, "path string, form string, weight double")
    held = retrieval.first_of_each(f, 5, ("form", "weight"), "path")
    assert max(r["count"] for r in held.distinct().groupBy("form", "weight").count().collect()) == 5
    got = retrieval.exact_candidates(spark.createDataFrame(tokens, "question_id long, at int, token string, is_identifier boolean"), f, "path", most=5)
    want = []
    for q in range(6):
        best = {}
        for own, at, token, known in tokens:
            for path, form, w in forms if own == q else []:
                if form.lower() == token.lower():
                    s = round(w * (1.0 if form == token else 0.8) * (1.0 if known else 0.5), 9)
                    best[path] = max(best.get(path, (0, 0)), (s, -at))
        want += [(q, path, s, place) for place, (path, (s, _)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:5], 1)]
    assert sorted((r.question_id, r.path, r.score, r.place) for r in got.collect()) == sorted(want)
