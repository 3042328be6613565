"""Secrets in texts: candidates by pattern or by a secret word before them, and a random forest that removes the false ones.

Only DataFrame functions and Spark ML's JVM forest run here. A candidate's numbers are its length, how
often neighbouring characters change their class, its characters' variety, the share of it that
dictionary words cover, marks of the path, and the words beside it. The forest is trained from labelled
findings: any table of ``(candidate, before, after, path, label)``; :func:`made_findings` makes one where
there are no own labels.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

LEAST = 16
LEAST_TOLD = 6
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 7, 5
FINDINGS = 8000
CANDIDATE = rf"[A-Za-z0-9_+/.\-]{{{LEAST},}}={{0,2}}"
# fixed values: words that identifiers, hosts and file names are made of
DICTIONARY = (
    "about access account action address admin after alert apache api app archive array asset auth author back base batch block board body book branch "
    "browser buffer build button cache call card center change channel char check class client cloud code color column com command comment commit common "
    "component config connect constant content context control copy core count create current custom data date debug default delete demo department "
    "description design detail device dialog digest directory display document domain download driver edit element email enable end engine error event "
    "example exception export factory feature field file filter find flag folder font format frame function general get global google group handler hash "
    "header height hello here home host html http icon image import index info input insert install instance integer interface internal item java key "
    "label language last layer length level library license limit line link list load local location login long mail main manager map master max member "
    "memory menu message meta method mobile mode model module month name native net network next node note number object office open option order org "
    "output package page panel param parent parse password path pattern payment phone place plan platform player plugin point policy port position post "
    "print private process product profile program project property provider public query queue random range read record reference register release remote "
    "report request resource response result return role root route sample schema score screen script search section security select send sequence server "
    "service session setting shared simple site size source space spring start state static status storage store stream string style submit summary support "
    "switch system table target task template test text theme thread time title token tool total track transaction transfer tree type unit update upload url "
    "user util valid value vector version video view visible visitor wait web widget width window word work world write year your zone"
).split()
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|credential|bearer|private.?key|auth)"
HARMLESS_WORDS = r"(?i)(commit|sha-?\d*\b|md5|checksum|digest|hash|uuid|guid|revision|etag|version|build|example|sample|dummy|placeholder|isbn|order|card|phone|e-?mail)"
# fixed values: a value that a secret word assigns, or that stands quoted after it, in the last word of what is searched
TOLD = SECRET_WORDS.replace("(token", "(?:token") + r"[\w.-]*[\"'`\])]*(?:\s*(?:=>|:=|[=:]+)\s*[(\[{]?"
TOLD_VALUES = (
    *(TOLD + rf"|\s+){q}([^\s{q}]{{{LEAST_TOLD},}}){q}(?=\S*$)" for q in "\"'`"),
    TOLD + rf")([^\s\"'`(\[{{][^\s\"'`]{{{LEAST_TOLD - 2},}}[^\s\"'`,;)\]}}])(?=\S*$)",
)
TEST_PATH = r"(?i)(^|[/_.-])(tests?|spec|fixtures?|examples?|samples?|docs?|mocks?|vendor)([/_.-]|$)"
NUMBERS = (
    "length", "changes", "letter_digit_changes", "case_changes", "distinct", "digits", "upper", "hexadecimal", "longest_letters", "dictionary", "marks", "repeats",
    "hosts", "secret_before", "secret_near", "harmless_before", "assigned", "quoted", "after_words", "test_path",
)


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """``(doc_id, word, candidate, before, after, path)``: every candidate with the words beside it.

    ``word`` is the number of its white-space-separated word, from 0.
    """
    own = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    split = docs.select("doc_id", own.alias("path"), F.split(text_or_empty(), r"\s+").alias("w"))
    beside = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    # get() of a negative index gives null
    told = lambda x, i: (F.length(x) >= LEAST_TOLD) & F.concat_ws(" ", beside(i - 2), beside(i - 1), x).rlike(SECRET_WORDS)
    long = F.transform("w", lambda x, i: F.when((F.length(x) >= LEAST) | told(x, i), F.struct(i.alias("word"), x.alias("own"), F.concat_ws(" ", beside(i - 2), beside(i - 1)).alias("before"), F.concat_ws(" ", beside(i + 1), beside(i + 2)).alias("after"))))
    found = split.select("doc_id", "path", F.explode(F.filter(long, lambda x: x.isNotNull())).alias("x")).select("doc_id", "path", "x.*")
    known = F.concat_ws(" ", "before", "own")
    every = F.concat(F.regexp_extract_all("own", F.lit(CANDIDATE), F.lit(0)), *[F.regexp_extract_all(known, F.lit(v), F.lit(1)) for v in TOLD_VALUES])
    each = found.select("doc_id", "path", "word", "own", "before", "after", F.explode(F.array_distinct(every)).alias("candidate"))
    ahead = F.concat_ws(" ", "before", F.expr("substring(own, 1, locate(candidate, own) - 1)"))
    behind = F.concat_ws(" ", F.expr("substring(own, locate(candidate, own) + length(candidate))"), "after")
    return each.select("doc_id", "word", "candidate", ahead.alias("before"), behind.alias("after"), "path")


def numbers() -> dict[str, Column]:
    """The numbers of a finding, from ``candidate``, ``before``, ``after`` and ``path``."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c)
    left = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    share = lambda pattern: 1 - left(pattern) / n
    times = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda x: x.cast("double")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    made = {
        "length": n.cast("double"),
        "changes": times(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "letter_digit_changes": times(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": times(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hexadecimal": flag(c.rlike(r"^([0-9a-f]+|[0-9A-F]+)$")),
        "longest_letters": F.array_max(F.transform(F.regexp_extract_all(F.concat(c, F.lit("a")), F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / n,
        "marks": share("[_+/.=-]"),
        "repeats": times(r"(.)(?=\1)"),
        "hosts": flag(c.rlike(r"(?i)\.(com|org|net|io|html?|js|py|java|txt|md)\b|^\d+(\.\d+)+$")),
        "secret_before": flag(before.rlike(SECRET_WORDS + r"[\"']?\s*(=>|[:=])?\s*[\"'`(]*$")),
        "secret_near": flag(F.concat_ws(" ", before, after).rlike(SECRET_WORDS)),
        "harmless_before": flag(before.rlike(HARMLESS_WORDS)),
        "assigned": flag(before.rlike(r"(=|:)\s*[\"'`(]*$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "after_words": flag(after.rlike(r"(?i)^\S*@|^\s*(here|example|placeholder)")),
        "test_path": flag(F.col("path").rlike(TEST_PATH)),
    }
    return {name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in NUMBERS}


def with_features(findings: DataFrame, name: str = "features") -> DataFrame:
    columns = [made.alias(f"__{n}") for n, made in numbers().items()]
    return VectorAssembler(inputCols=[f"__{n}" for n in NUMBERS], outputCol=name).transform(findings.select("*", *columns)).drop(*[f"__{n}" for n in NUMBERS])


def made_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """Labelled findings made by rule: random keys after telling words, and what is mistaken for them."""
    rng = random.Random(seed)
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    word = lambda: some("eeetttaaooinshrdlu", 2, 10)
    known = lambda: rng.choice(DICTIONARY)
    hexes = lambda: rng.choice((str.lower, str.lower, str.upper))(some("0123456789abcdef", n := rng.choice((32, 40, 40, 64)), n))
    dense = lambda low, high: some(string.ascii_letters + string.digits, low, high)

    def key() -> str:
        return rng.choice((hexes, hexes, lambda: dense(20, 44), lambda: dense(24, 40) + "==", lambda: rng.choice(("ghp_", "sk-", "pk_live_", "AKIA", "xoxb-")) + dense(16, 36)))()

    def harmless() -> str:
        return rng.choice((
            lambda: "".join(word() for _ in range(6)).ljust(LEAST, "e"), lambda: "".join(word() for _ in range(6)).ljust(LEAST, "n").upper(), lambda: some(string.digits, 16, 19),
            lambda: f"{word()}.{known()}.{known()}{rng.randint(0, 99)}.example.com", lambda: "/".join(known() for _ in range(4)) + rng.choice((".java", ".py", ".html", ".txt")),
            lambda: "".join(known().title() for _ in range(4)), lambda: "-".join((word(), known(), word(), known(), word())), lambda: "_".join(known() for _ in range(4)),
        ))()

    def told() -> tuple[str, str]:
        sign, close = rng.choice(((' = "', '"'), (' = "', '"'), ('="', '"'), (': "', '"'), ("='", "'"), (" ", ""), (": ", ""), (" = ", "")))
        name = rng.choice(("token", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "Bearer", "private_key"))
        return f"{word()} {name}{sign}", f"{close} {word()}"

    found = []
    for _ in range(rows):
        kind, path = rng.randrange(20), rng.choice(("src/app.py", "lib/main.js", "config/prod.env", "src3", "src17", "data/dump.txt", ""))
        plain = (f"{word()} {word()} ", f" {word()} {word()}")
        if kind < 9:
            row = (key(), *told(), path, 1.0)
        elif kind == 9:
            row = (rng.choice(("your_api_key_here", "your-secret-token-here", some("x", 16, 40), some("0", 16, 40), "example_access_token", "PLACEHOLDER_SECRET_KEY", "replace_with_password_value")), *told(), path, 0.0)
        elif kind in (10, 11):
            uuid = "-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
            row = (rng.choice((uuid, hexes())), f"{word()} {rng.choice(('commit', 'sha1', 'md5', 'checksum', 'revision', 'digest of', 'etag', 'uuid', 'hash'))}{rng.choice((' ', ': ', ' = '))}", plain[1], path, 0.0)
        elif kind == 12:
            row = (key(), *told(), rng.choice(("tests/unit/auth.py", "fixtures/keys.json", "docs/example.md", "examples/client.py")), 0.0)
        elif kind == 13:
            row = (harmless(), *told(), path, 0.0)
        elif kind == 14:
            row = (f"{word()}.{word()}{word()}.{rng.randint(10, 99)}", plain[0], f"@mail{rng.randint(1, 9)}.example.com {word()}", path, 0.0)
        else:
            row = (harmless(), *plain, path, 0.0)
        found.append(row)
    found = [r for r in found if len(r[0]) >= LEAST]

    def chosen() -> str:
        """A password as people choose it: letters with digits, often with signs."""
        parts = [rng.choice((word(), known(), known().title(), dense(3, 8))), some(string.digits, 1, 4), *rng.choice(((), (some("!@#$%^&*:?", 1, 2),), (some("!@#$%:&", 1, 1), dense(3, 8)), (dense(1, 4),)))]
        if rng.random() < 0.5:
            rng.shuffle(parts)
        return "".join(parts).ljust(LEAST_TOLD, rng.choice(string.digits))

    def plain_value() -> str:
        return rng.choice((lambda: known().ljust(LEAST_TOLD, "s"), lambda: word().ljust(LEAST_TOLD, "e"), lambda: word().title().ljust(LEAST_TOLD, "n"), lambda: f"{known()}_{known()}", lambda: f"{known()}.{known()}", lambda: f"{known()}-{known()}", lambda: f"{known()}()".rjust(LEAST_TOLD, "g"), lambda: "${" + known().upper() + "}", lambda: f"<{known()}>".ljust(LEAST_TOLD, ">"), lambda: "*" * rng.randint(6, 12), lambda: some(string.digits, 6, 9)))()

    for _ in range(rows // 4):
        path = rng.choice(("src/app.py", "lib/main.js", "config/prod.env", "src3", "src17", ""))
        found.append((chosen(), *told(), path, 1.0) if rng.random() < 0.5 else (plain_value(), *told(), path, 0.0))
    return spark.createDataFrame(found, "candidate string, before string, after string, path string, label double")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from findings ``(candidate, before, after, path, label)``; rows without a candidate or label take no part."""
    known = findings.where("candidate is not null and label is not null").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")], F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(with_features(known))


def secrets(docs: DataFrame, forest: RandomForestClassificationModel, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, word, candidate, score, predicted)``: every candidate, its score, and 1 where it is kept as a secret.

    Null and empty texts have no candidates; a missing or null path counts as empty; repeated rows give
    repeated rows; null doc_ids stay; further columns are not read; empty tables give no rows. A candidate that
    stands several times in one white-space-separated word is one row.
    """
    scored = forest.transform(with_features(candidates(docs, path)))
    chance = F.round(vector_to_array("probability")[1], 9)
    return scored.select("doc_id", "word", "candidate", chance.alias("score"), (chance >= threshold).cast("int").alias("predicted"))
