"""Periodic runs, language identification and the manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagloom.llm import language_id, merkle, periodic_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, total int, key string"


def _rows():
    rng = random.Random(11)
    words = ["a", "B", "c", "dd", "É", "The"]
    texts = [None, "", " \t\n", "one", "x " * 40, "a b " * 9 + "c", "long word " * 9000, "日 本 語 " * 5 + "½", "A B\x0b\x0cC " * 12]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 70))) for _ in range(60)]
    texts += [" ".join(rng.choice(words[:2]) for _ in range(40)) for _ in range(20)]
    rows = [(i, t, None if i % 9 == 0 else "en" if i % 2 else "dé", f"s{i % 3}", len(t or ""), "r", 1, "k") for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id A", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tables')}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def _runs(a, shortest=12):
    out, seen = [], set()
    for p in range(1, len(a) // 2 + 1):
        i = 0
        while i + p < len(a):
            if a[i] != a[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(a) and a[i] == a[i + p]:
                i += 1
            if i + p - start >= max(shortest, 2 * p) and (start, i) not in {(s, e - q) for s, e, q in seen if q == p} and (start, i + p) not in {(s, e) for s, e, _ in seen}:
                seen.add((start, i + p, p))
                out.append((start, i + p - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(600):
        n, many = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        a = [rng.randrange(many) for _ in range(n)]
        for _ in range(3 if n and rng.random() < 0.6 else 0):
            s, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(s + p, min(n, s + p * rng.randint(2, 5))):
                a[i] = a[i - p]
        assert periodic_runs.find_runs(np.array(a, "i8")) == _runs(a)


def test_runs_of_long_repetitive_texts():
    f, g = [0], [0, 1]
    while len(g) < 1500:
        f, g = g, g + f
    blocks = [w for k in range(1, 9) for w in [0] * 150 + [k]]
    for a in (g, blocks, [7] * 3000):
        assert periodic_runs.find_runs(np.array(a)) == _runs(a)


def test_op11_equals_brute_force(spark, folder):
    found = periodic_runs.op11_periodic_runs(spark, folder).collect()
    assert len(found) == len(_rows())
    wanted = Counter()
    for row in _rows():
        words = _planted(row[0], row[1])
        runs = _runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        wanted[(row[0], len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in found) == wanted
    assert any(r["n_runs"] > 1 for r in found)


def test_runs_interface(docs, empty):
    rows = {r["source"]: r for r in periodic_runs.periodic_runs(docs.where("doc_id = 5"), keep=("source", "lang")).collect()}
    assert [tuple(x) for x in rows["s2"]["runs"]] == [(0, 18, 2)] and rows["s2"]["collapsed"] == "a b c" and rows["s2"]["n_words"] == 19
    assert periodic_runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, keep=("runs",))


# Language identification


def _train(texts, order):
    n = defaultdict(Counter)
    for t in texts:
        s = [256] * order + list(t.encode())
        for i in range(order, len(s)):
            for d in range(order + 1):
                n[tuple(s[i - d : i])][s[i]] += 1
    return n


def _length(n, text, order):
    s, units = [256] * order + list(text.encode()), 0
    for i in range(order, len(s)):
        for d in range(order, -1, -1):
            seen = n.get(tuple(s[i - d : i]))
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s[i] in seen:
                units += round(-math.log2(seen[s[i]] / whole) * 65536)
                break
            units += round(-math.log2(len(seen) / whole) * 65536)
        else:
            units += 8 * 65536
    return units / 65536


TAUGHT = {"de": ["der Hund und die Katze", "größer als das Haus", "die die die"], "en": ["the dog and the cat", "a bigger house", "the the the"], "fr": ["le chien et la forêt", "été à la mer"]}


def test_code_lengths_equal_brute_force(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in TAUGHT.items() for t in ts)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "nothing known", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.PpmLanguages.fit(labelled)
    assert model.trees.languages == ["de", "en", "fr"]
    texts = ["der", "the cat", "été", "x", "日本 z", "the der le", "ab" * 4000, "größe the", None, "", "12 34", "the cat"]
    asked = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "la mer", None, None)], "doc_id long, text string, lang string, score int")
    found = {r["doc_id"]: r for r in model.predict(asked).collect()}
    assert len(found) == len(texts) + 1 and found[None]["lang_pred"] == "fr"
    trees = {k: _train(ts, 4) for k, ts in TAUGHT.items()}
    for i, t in enumerate(texts):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (found[i]["lang_pred"], found[i]["score"], found[i]["bits"]) == ("und", 0.0, {})
            continue
        bits = {k: _length(trees[k], t, 4) for k in trees}
        assert found[i]["bits"] == bits
        best = min(bits.values())
        assert found[i]["lang_pred"] == min(k for k in bits if bits[k] == best)
        assert found[i]["score"] == pytest.approx(1 / sum(2.0 ** max(best - b, -1000) for b in bits.values()), rel=1e-12)


def test_windows_and_ties_of_code_lengths(monkeypatch):
    keys = language_id.strings(language_id.symbols(pa.array(["ab", "ba"]), 2)[0], 0, 8, 3)
    lang = np.array([0, 0, 1, 1])
    trees = language_id.PpmTrees(["x", "y"], 2, lang, keys[[2, 3, 2, 3]], np.ones(4, "i8"))
    texts = pa.array(["abba" * 50, None, "", "b", "a" * 7])
    whole = trees.lengths(texts)
    names, score, _ = trees.judge(texts)
    assert names == ["x"] * 5 and score.tolist() == [0.5] * 5  # equal trees: the first name
    for cells in (2, 6, 22, 128):
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert (trees.lengths(texts) == whole).all()
    assert (trees.lengths(texts.slice(1, 3)) == whole[1:4]).all()


def test_slots_find_what_they_hold():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 45, 20000))
    slots = language_id.Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(keys + 1, keys)
    assert (slots.find(other) == -1).all()


def test_sample_is_bounded_and_nothing_learned_is_und(spark, empty):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang")
    model = language_id.PpmLanguages.fit(rows, rows=100, order=2)
    taught = model.trees.costs[0].shape
    assert taught[1] == 2 and model.predict(rows.limit(5)).count() == 5
    nothing = language_id.PpmLanguages.fit(empty)
    assert {r["lang_pred"] for r in nothing.predict(rows.limit(3)).collect()} == {"und"}
    assert model.predict(empty).collect() == []


def test_op12_on_held_out_documents(spark):
    d = "/root/testdata/sf0.001"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = language_id.op12_partial_matching(spark, d).join(lang, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["truth"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


# Manifest


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _digest(*values):
    return _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes, fanout):
    """The root and each leaf's siblings, level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = p // fanout * fanout
            proofs[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        nodes = [_sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        places = [p // fanout for p in places]
    return nodes[0], proofs


def _wanted(rows, fanout):
    leaves = defaultdict(list)
    for doc_id, text, lang, source, n, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        leaf = _digest(doc_id, source, lang, n, text)
        leaves[lang].append((doc_id is not None, doc_id or 0, leaf, _digest(doc_id, source, lang, n, lower) if tampered else leaf))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: (sorted(leaves[k]), *_tree([x[2] for x in sorted(leaves[k])], fanout)) for k in langs}
    root, above = _tree([trees[k][1] for k in langs], fanout)
    out = Counter()
    for k, upper in zip(langs, above, strict=True):
        for (known, doc_id, leaf, told), lower in zip(trees[k][0], trees[k][2], strict=True):
            proof, node = lower + upper, told
            for left, right in proof:
                node = _sha(left, node, right)
            out[(doc_id if known else None, leaf, trees[k][1], root, _sha(*(x for s in proof for x in s)), node, node == root)] += 1
    return out


def test_op13_equals_brute_force(spark, folder):
    rows = merkle.op13_superblock_manifest(spark, folder).collect()
    assert Counter(tuple(r) for r in rows) == _wanted(_rows(), 8)
    assert {r["verified"] for r in rows} == {True, False}


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (8, 1)])
def test_manifest_by_every_size_of_superblock(docs, fanout, levels):
    leaves = docs.select("doc_id", "lang", "total", merkle.row_digest(*(F.col(c) for c in merkle.FIELDS)).alias("leaf"))
    rows = merkle.manifest(leaves, keep=("doc_id", "total"), fanout=fanout, levels=levels)
    found = rows.select("kept.doc_id", "leaf", "subroot", "root", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("again"), "kept.total").collect()
    wanted = Counter((k[0], *k[1:5]) for k in _wanted(_rows(), fanout).elements())
    assert Counter((r[0], r[1], r[2], r[3], _sha(*(x for s in r["proof"] for x in s))) for r in found) == wanted
    assert all(r["again"] == r["root"] for r in found)


def test_manifest_of_few_rows(spark, docs, empty):
    leaf = merkle.row_digest(*(F.col(c) for c in merkle.FIELDS)).alias("leaf")
    one = merkle.manifest(docs.where("doc_id = 3").select("doc_id", "lang", leaf)).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["subroot"] == one[0]["leaf"] and one[0]["proof"] == []
    assert merkle.manifest(empty.select("doc_id", "lang", leaf)).collect() == []
