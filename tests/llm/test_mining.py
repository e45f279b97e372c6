"""Phrase mining, the Merkle manifest and nearest neighbours against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplane.llm import ann, merkle, phrases

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, phrase string, tree string, n long, leaf string"


def rows(n=120, seed=1):
    """Documents with nulls in any column, repeated rows and ids, copies and clashing columns."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["New", "york", "The", "a", "x\x0by", "é", "ÀB", "co-op", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", "\t ", ". ", "\n", "; "]) for w in words) + "New York city. new york City"
        out.append((i, ["s", None][i % 2], ["en", "de", None, "", "und"][i % 5], [i, None][i % 3 == 0], text, "p", "t", 1, "l"))
    return out + [(n, None, "en", 1, None, None, None, None, None), (n + 1, "s", "en", 0, "", None, None, None, None), (None, "s", "en", 3, "ABC New", None, None, None, None), out[3], out[3], (3, "s", "en", 1, "other", None, None, None, None)]


# phrases


def collocations(docs, least, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in (1, 2, 3):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *words), a in found.items():
        cuts = [(1000000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(p[0] == lang and len(p) - 1 > len(words) and tuple(words) in [p[i : i + len(words)] for i in range(1, len(p))] and 100 * b >= 50 * a for p, b in found.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, best in out.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1))


@pytest.mark.parametrize("least, top, bits", [(4, 2000, 20), (2, 7, 16), (3, 50, 3)])
def test_collocations_match_plain_counts(spark, least, top, bits):
    """Few buckets collide all the time, which may cost time only."""
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = phrases.collocations(docs, least, 3, top, bits).collect()
    assert sorted(map(tuple, got)) == collocations([(r["lang"], r["text"]) for r in docs.collect()], least, top)


def test_phrases_across_slices_count_once(spark, monkeypatch):
    """A text longer than a slice gives the counts that it gives whole."""
    text = " ".join(f"w{i % 7}" if i % 11 else "x. y" for i in range(400))
    whole = phrases._Pass(1, None, None, None, 8, 2, 3)
    monkeypatch.setattr(phrases, "SLICE", 37)
    for m, frequent in ((1, None), (2, b"\xff" * 32), (3, b"\xff" * 32)):
        task = phrases._Pass(m, None, frequent, frequent, 8, 200, 3)
        batches = [*task.text("en", text.encode()), *task.catch_up(), *task.flush()]
        got = {p: n for b in batches for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
        want, longer = collections.Counter(), 0
        for piece in text.split("."):
            words = piece.split()
            want.update(" ".join(words[i : i + m]).encode() for i in range(len(words) - m + 1))
            longer += max(0, len(words) - m)
        assert got == want
        assert task.buckets is None or task.buckets.table.astype(int).sum() == longer
    assert whole.m == 1


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 5 * 10**12), ("en", "a b", 3 * 10**12 + 1)], "lang string, phrase string, a long")
    pair = counts.where("phrase = 'a b'").selectExpr("*", "split(phrase, ' ') AS words")
    assert phrases._scored(pair, counts).first()["score"] == 1000000 * (3 * 10**12 + 1) ** 2 // (20 * 10**24)


def test_phrase_tables_are_not_broadcast(spark, tmp_path):
    """However small their files are; the driver would hold each phrase eight times."""
    rows = [("en", w, 10) for w in ("a", "b", "a b", "b a", "a b a")]
    spark.createDataFrame(rows, "lang string, phrase string, a long").write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    found = counts.where("phrase LIKE '% %'").withColumn("words", F.split("phrase", " "))
    kept = phrases._apart(phrases._scored(found, counts), found)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1e6
    assert kept.collect()[0].phrase == "a b a"
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan


def test_no_documents_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), bits=10).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], SCHEMA), bits=10).collect() == []


# manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest(docs):
    leaf = lambda r: h(map(encoded, r))

    def up(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
            levels.append(nodes)
        return levels

    def beside(levels, i):
        for nodes in levels[:-1]:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            yield i % 8, run[: i % 8] + run[i % 8 + 1 :]
            i //= 8

    groups = collections.defaultdict(list)
    for r in docs:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(groups[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: up([leaf(r) for r in ordered[x]]) for x in names}
    top = up([trees[x][-1][0] for x in names])
    for t, x in enumerate(names):
        for i, r in enumerate(ordered[x]):
            path = [*beside(trees[x], i), *beside(top, t)]
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for k, others in path:
                folded = h([*others[:k], folded, *others[k:]])
            yield r[0], leaf(r), trees[x][-1][0], top[-1][0], h([d for _, o in path for d in o]), folded, folded == top[-1][0]


def keyed(found):
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("n, layer", [(0, 4), (1, 4), (2, 1), (130, 4), (700, 1), (700, 2)])
def test_manifest_matches_plain_trees(spark, n, layer, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 60)
    docs = (rows(n) if n > 2 else rows()[:n]) + [(10_000 + i, None, f"lang{i}", None, None, None, None, None, None) for i in range(9 if n == 700 else 0)]
    got = merkle.manifest(spark.createDataFrame(docs, SCHEMA), layer).collect()
    assert keyed(map(tuple, got)) == keyed(manifest([r[:5] for r in docs]))
    assert n < 100 or 0 < sum(r["verified"] for r in got) < len(got)


def test_a_changed_leaf_or_path_does_not_verify():
    levels = [["%064x" % i for i in range(20)]]
    path = ((3, levels[0][:3] + levels[0][4:8]), ((0, ["f" * 64]), None))
    assert merkle.fold(levels[0][3], path) == h([h(levels[0][:8]), "f" * 64])
    assert merkle.fold("0" * 64, path) != merkle.fold(levels[0][3], path)
    assert merkle.proof(path) == h(levels[0][:3] + levels[0][4:8] + ["f" * 64]) and merkle.proof(None) == h([])


# nearest neighbours

VECTORS = "vec_id long, embedding array<double>, dim string, leaf string, uid string"


def true_neighbours(vectors, k=20):
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in usable:
        if i % 20 == 0:
            near = sorted(((float(ann.exact_scores(np.array(q), np.array(v))), -j) for j, v in usable if j != i and len(v) == len(q)), reverse=True)[:k]
            yield from ((i, rank, -j, score) for rank, (score, j) in enumerate(near, 1))


def test_neighbours_are_exact_when_all_leaves_are_visited(spark):
    """Nulls, zeros, several lengths, copies beyond a list's length, repeated ids and queries without enough partners."""
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    vectors += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(40, v) for _, v in vectors[:25]] + [vectors[20], vectors[20]]
    vectors += [(2000 + i, [float(i), 1.0]) for i in range(4)] + [(2020, [1.0, 2.0]), (3000, [5.0]), (None, [1.0] * 6), (400, None), (420, []), (440, [0.0] * 6), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [None] * 6)]
    df = spark.createDataFrame([(i, v, "d", "l", "u") for i, v in vectors], VECTORS).repartition(3)
    got = ann.nearest(df, target=1.0).collect()
    assert sorted(map(tuple, got)) == sorted(true_neighbours(vectors))


def test_tiles_and_bins_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(500)]
    vectors = [(i, v if any(v) else [1.0] * 5) for i, v in vectors]
    for name, value in (("ROWS_PER_TILE", 30), ("QUERIES_PER_TILE", 4), ("ROWS_PER_BIN", 50)):
        monkeypatch.setattr(ann, name, value)
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in vectors], VECTORS)
    assert sorted(map(tuple, ann.nearest(df, target=1.0).collect())) == sorted(true_neighbours(vectors))


def test_recall_is_calibrated(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vectors = [(i, (centres[i % 40] + rng.normal(size=16) * 0.6).tolist()) for i in range(4000)]
    index = ann.Index(spark.createDataFrame([(i, v, None, None, None) for i, v in vectors], VECTORS), target=0.95)
    assert index.visits[16] < index.trees.value[16].leaves / 2
    x, ids = np.array([v for _, v in vectors]), np.arange(4000)
    got = collections.defaultdict(set)
    for r in index.search().collect():
        got[r["query_id"]].add(r["vec_id"])
    shares = []
    for q in ids[ids % 20 == 0]:
        scores = x @ x[q]
        scores[q] = -np.inf
        shares.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.9


def test_no_vectors_no_neighbours(spark):
    assert ann.nearest(spark.createDataFrame([(1, None, None, None, None)], VECTORS)).collect() == []
    one = ann.nearest(spark.createDataFrame([(20, [1.0, 2.0], None, None, None)], VECTORS))
    assert one.collect() == [] and one.columns == ["query_id", "rank", "vec_id", "score"]
