"""Secret scan: candidates by pattern, false positives out by a random forest.

The forest sees a candidate's length, how its characters follow one another,
how far words of a dictionary cover it (common ones of code and settings, and
the commonest of the corpus itself), its path and the words before it. It is
trained on labelled findings and then written out as one SQL expression, so
scanning is a narrow pass of built-in functions: no shuffle, no Python.

Defined results: null, empty and blank texts have no candidates; a null path
counts as empty; a candidate is the whole run, however long; beyond MOST
characters its pieces are judged apart, each with the run's prefix, name and
context, and its score is that of the piece judged highest; every input row
gives its own findings; a table without rows gives no findings. Other columns are ignored by ``scan`` and
kept as they are by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .secret_labels import labelled_findings

MOST, NEAR = 256, 48
TREES, DEPTH, SEED = 24, 6, 5
THRESHOLD = 0.5
MASK = "[secret]"

# What can be a candidate, and the words looked for around it. A
# candidate starts where a run of _CHAR starts: it is a keyword's assignment
# (any case and spacing; a quoted value goes to its closing quote, another to
# the next blank), else a run with a digit or with a known prefix. The name that
# is assigned to counts as text before the candidate.
_CHAR = r"A-Za-z0-9_+/=.@\-"
_KNOWN = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|glpat-|AIza|eyJ)"
_KEYWORD = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\-]?key|auth|cred(?:ential)?s?|private[_\-]?key|access[_\-]?key|bearer)"
_ASSIGN = r"\\?[\"']?[ \t]*+[=:]{1,2}+>?[ \t]*+"
_ASSIGNED = (
    r"(?:\\\"(?=[^\"\r\n]{6})[^\"\\\r\n]++(?=\\\")"
    r"|\"(?=[^\"\r\n]{6})[^\"\\\r\n]*+(?:\\[^\r\n][^\"\\\r\n]*+){0,99}+(?=\")"
    r"|'(?=[^'\r\n]{6})[^'\\\r\n]*+(?:\\[^\r\n][^'\\\r\n]*+){0,99}+(?=')"
    r"|\\?[\"']?(?=[^\s\"]{6})[^\s\"'][^\s\"']*+(?:'(?=\w)[^\s\"']*+){0,99}+)"
)
_NAME = rf"[{_CHAR}]*?{_KEYWORD}[A-Za-z0-9_\-]{{0,16}}+{_ASSIGN}"
NAME = rf"(?s)^{_NAME}(?:\\?[\"'])?(?=.{{6}})"
CANDIDATE = (
    rf"(?<![{_CHAR}])(?:{_NAME}{_ASSIGNED}"
    rf"|(?=[A-Za-z_+/=.@\-]*+[0-9])[{_CHAR}]{{8,}}+"
    rf"|[{_CHAR}]*?{_KNOWN}[{_CHAR}]{{8,}}+)"
)
KEYS = "pass|pwd|secret|token|api[_-]?key|auth|cred|private|bearer|access[_-]?key"
BENIGN = "commit|sha|checksum|md5|etag|integrity|uuid|trace|request|version|phone|tel|card|isbn|order|http|mail|id="
KNOWN = _KNOWN
TESTS = "test|example|sample|fixture|mock|demo|lock|doc"
SHARED = 7
DICTIONARY = (
    "about access account admin after build call card case change changeme chapter check client code commit "
    "config data date default demo digest dummy example figure file find form from group handler have here home "
    "image index info integrity invoice item key license list load login mail make name number order other page "
    "password path phone placeholder private public release report request sample script secret section server "
    "service session string table test text that this time title token trace type update user value version "
    "with word work your"
).split()
#: Words of the corpus that join the dictionary: the commonest by documents, of
#: so many letters.
WORDS, LETTERS = 256, (4, 16)

FEATURES = (
    "length digits upper lower hex changes flow distinct words key_near benign_near known domain numeric tests uuid"
).split()


def common_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The corpus's words that the most documents hold, ties in order of the
    alphabet: counted over all texts, summed in each task before the shuffle."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+")))
    counts = docs.select(word.alias("word")).where(F.length("word").between(*LETTERS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def _flow_table(labelled: DataFrame) -> dict[str, float]:
    """How much likelier one class of characters follows another in secrets
    than in other candidates: log-odds of each pair, at most 49 rows."""
    pairs = labelled.select("label", _classes(_value(F.col("value"))).alias("c")).select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("c") - 1, F.lit(1))), lambda i: F.substr("c", i, F.lit(2)))).alias("pair")
    )
    rows = pairs.where("length(pair) = 2").groupBy("pair").agg(
        F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")
    )
    rows = rows.collect()
    yes, no = (sum(r[k] for r in rows) + len(rows) for k in ("yes", "no"))
    from math import log

    return {r["pair"]: round(log((r["yes"] + 1) / yes) - log((r["no"] + 1) / no), 6) for r in sorted(rows)}


def _value(candidate: Column) -> Column:
    """What a candidate such as key=value assigns; else all of it."""
    after = F.regexp_extract(candidate, r"^[A-Za-z_\-]+[=:] ?[\"']?([^=].*)$", 1)
    return F.when(F.length(after) >= 6, after).otherwise(candidate)


def _classes(value: Column) -> Column:
    letters = "aeiou" + "bcdf" + "ghjklmnpqrstvwxyz" + "ABCDEF" + "GHIJKLMNOPQRSTUVWXYZ" + "0123456789"
    kinds = "v" * 5 + "h" * 4 + "c" * 17 + "H" * 6 + "U" * 20 + "0" * 10
    return F.regexp_replace(F.translate(value, letters, kinds), "[^vhcHU0]", "-")


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _pieces(value: Column) -> Column:
    """MOST characters each; a rest under 8 belongs to the last piece."""
    cut = F.regexp_extract_all(value, F.lit(rf"(?s).{{{MOST}}}(?:.{{1,7}}\z)?|.+"), F.lit(0))
    return F.when(F.length(value) > MOST, cut).otherwise(F.array(value))


def _flag(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(pattern)).cast("double")


def _of_run(candidate: Column, before: Column, path: Column) -> list[Column]:
    """What all pieces of a candidate share."""
    v = _value(candidate)
    key = F.regexp_extract(candidate, r"^([A-Za-z_\-]+)[=:]", 1)
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), key))
    columns = [
        F.length(v),
        _flag(near, KEYS),
        _flag(near, BENIGN),
        _flag(v, KNOWN),
        _flag(v, r"@|://|^www\.|\.[a-z]{2,4}(/|$)"),
        _flag(F.lower(path), TESTS),
        _flag(v, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ]
    return [x.cast("double") for x in columns]


def features(v: Column, run: list[Column], flow: dict[str, float], words: list[str]) -> list[Column]:
    """Of one piece of a candidate whose shared ones are run."""
    c = _classes(v)
    table = F.create_map(*[F.lit(x) for kv in (flow or {"--": 0.0}).items() for x in kv])
    steps = F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1)))
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(table, F.substr(c, i, F.lit(2))), F.lit(0.0)))
    runs = F.regexp_replace(F.regexp_replace(c, "[vhc]", "a"), "[HU]", "A")
    columns = [
        run[0],
        1 - _share(v, "[0-9]"),
        1 - _share(v, "[A-Z]"),
        1 - _share(v, "[a-z]"),
        _flag(v, "^[0-9a-f]+$"),
        F.length(F.regexp_replace(runs, r"(.)\1+", "$1")) / F.greatest(F.length(v), F.lit(1)),
        total / F.greatest(F.length(c) - 1, F.lit(1)),
        F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.length(v), F.lit(1)),
        1 - _share(F.lower(v), "|".join(sorted({*DICTIONARY, *words}, key=lambda w: (-len(w), w)))),
        *run[1:5],
        _flag(v, r"^[0-9.\-/()]+$"),
        *run[5:],
    ]
    return [x.cast("double") for x in columns]


class SecretForest:
    """A trained forest: the flow table, its trees as nested tuples, and the
    corpus's words in the dictionary."""

    def __init__(self, flow: dict[str, float], trees: list, words: list[str]):
        self.flow, self.trees, self.words = flow, trees, words

    @classmethod
    def for_corpus(cls, docs: DataFrame) -> SecretForest:
        """Trained on the findings made by rule, with the corpus's own words."""
        words = common_words(docs)
        return cls.train(labelled_findings(docs.sparkSession, words=words), words)

    @classmethod
    def train(cls, labelled: DataFrame, words: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> SecretForest:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.functions import array_to_vector

        flow = _flow_table(labelled)
        run = F.array(*_of_run(F.col("value"), F.col("before"), F.col("path"))).alias("run")
        cut = labelled.select("label", run, F.explode(_pieces(_value(F.col("value")))).alias("piece"))
        columns = features(F.col("piece"), [F.col("run")[k] for k in range(SHARED)], flow, list(words))
        rows = cut.select(array_to_vector(F.array(*columns)).alias("features"), F.col("label").cast("double").alias("label"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
        model = forest.fit(rows.coalesce(2))
        return cls(flow, [_parsed(t.toDebugString) for t in model.trees], list(words))

    def score(self, f: Column) -> Column:
        """Share of the trees that call an array of features a secret."""
        votes = [_as_sql(t, f) for t in self.trees]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return total / F.lit(float(len(votes)))


def _parsed(shown: str):
    """(feature, threshold, left, right) or a leaf's label, from a tree's text."""
    lines = [x.strip() for x in shown.splitlines()[1:] if x.strip()]

    def node():
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        k, least = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        lines.pop(0)
        return int(k), float(least), left, node()

    return node()


def _as_sql(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    k, least, left, right = tree
    if left == right:
        return _as_sql(left, f)
    return F.when(f[k] <= F.lit(least), _as_sql(left, f)).otherwise(_as_sql(right, f))


def _judged(docs: DataFrame, forest: SecretForest, path: str | None) -> DataFrame:
    """docs with _gaps (text between candidates), _found (candidates) and
    _scores, one for each candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    pattern = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    cut = docs.select(
        "*",
        F.expr(f"split(coalesce(cast(text AS string), ''), '{pattern}', -1)").alias("_gaps"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_found"),
        where.alias("_path"),
    )
    name = lambda c: F.regexp_extract(c, NAME, 0)
    cut = cut.withColumn("_names", F.transform("_found", name)).withColumns({
        "_gaps": F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.get("_names", i), F.lit("")))),
        "_found": F.zip_with("_found", "_names", lambda c, n: F.substr(c, F.length(n) + 1)),
    })
    runs = cut.withColumn("_runs", F.transform("_found", lambda c, i: F.struct(
        _pieces(_value(c)).alias("pieces"), F.array(*_of_run(c, _before(i), F.col("_path"))).alias("shared")
    )))
    measured = runs.withColumn("_features", F.transform("_runs", lambda r: F.transform(
        r["pieces"], lambda p: F.array(*features(p, [r["shared"][k] for k in range(SHARED)], forest.flow, forest.words))
    )))
    return measured.withColumn("_scores", F.transform("_features", lambda f: F.array_max(F.transform(f, forest.score))))


def _before(i: Column) -> Column:
    """The NEAR characters before a candidate, other candidates included: with
    the gap after it a candidate has 9 characters or more, so 6 of them do."""
    end = lambda x, k: F.coalesce(F.right(F.get(x, i - k), F.lit(NEAR)), F.lit(""))
    earlier = [end(x, k) for k in range(-(-NEAR // 9), 0, -1) for x in ("_gaps", "_found")]
    gap = F.get("_gaps", i)
    return F.when(F.length(gap) >= NEAR, F.right(gap, F.lit(NEAR))).otherwise(F.right(F.concat(*earlier, gap), F.lit(NEAR)))


def scan(docs: DataFrame, forest: SecretForest, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: doc_id, finding (its number in the text),
    length, shown (its first four characters), value_sha256, score, secret."""
    found = _judged(docs.select("doc_id", "text", *([path] if path and path not in ("doc_id", "text") else [])), forest, path)
    rows = found.select("doc_id", F.posexplode(F.arrays_zip("_found", "_scores")).alias("finding", "f"))
    return rows.select(
        "doc_id",
        "finding",
        F.length("f._found").alias("length"),
        F.substr("f._found", F.lit(1), F.lit(4)).alias("shown"),
        F.sha2("f._found", 256).alias("value_sha256"),
        F.col("f._scores").alias("score"),
        (F.col("f._scores") >= threshold).alias("secret"),
    )


def redact(docs: DataFrame, forest: SecretForest, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs, each secret replaced by MASK; n_chars follows where there is one."""
    columns = docs.columns
    # Own columns are numbered meanwhile, so that none is called as a helper.
    held = {c: "text" if c == "text" else f"own{k}" for k, c in enumerate(columns)}
    found = _judged(docs.toDF(*held.values()), forest, held[path] if path else None)
    parts = F.zip_with(
        F.zip_with("_found", "_scores", lambda c, s: F.when(s >= threshold, F.lit(MASK)).otherwise(c)),
        F.slice("_gaps", F.lit(2), F.greatest(F.size("_gaps") - 1, F.lit(0))),
        lambda c, g: F.concat(c, F.coalesce(g, F.lit(""))),
    )
    any_secret = F.exists("_scores", lambda s: s >= threshold)
    clean = F.when(any_secret, F.concat(F.get("_gaps", F.lit(0)), F.array_join(parts, ""))).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in columns:
        n = F.when(any_secret, F.length("text")).otherwise(F.col(held["n_chars"]))
        out = out.withColumn(held["n_chars"], n.cast(docs.schema["n_chars"].dataType))
    return out.select(*held.values()).toDF(*columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, SecretForest.for_corpus(docs))
