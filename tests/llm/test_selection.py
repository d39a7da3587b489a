"""Hard negatives, importance resampling and line dedup against brute force, and on odd input."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import hard_negatives, line_dedup, pii, resampling

UP = {c: c + 32 for c in range(65, 91)}

# -- hard negatives --------------------------------------------------------------------------


def vectors(spark, rows):
    """rows: (vec_id, embedding, label), with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "c", 1.5, [1]) for r in rows], "vec_id long, embedding array<double>, label int, id string, score double, slots array<int>")


def brute_mine(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    use = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in use if anchors(r[0])}):
        v, lab = min((r[1], str(r[2])) for r in use if r[0] == a)
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, str(lb) == lab) for i, w, lb in use if i != a and len(w) == len(v)]
        score.sort()
        for p, pid, same in [s for s in score if s[2]][:positives]:
            inside = [(s, i) for s, i, same2 in score if not same2 and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a, pid, n, i, -p, -s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def cloud(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=d) * 0.7], int(rng.integers(4))) for i in range(n)]
    return [(i, [x / 4 for x in v], lab) for i, v, lab in rows]


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = cloud()
    rows += [(1000 + i, rows[7][1], 1 + i % 2) for i in range(60)]  # a group of copies: ties
    rows += [rows[20], rows[20], (20, rows[3][1], 2)]  # repeated rows, and an anchor of two vectors
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None] + [0.0] * 10, 1), (2003, [float("nan")] * 12, 1), (2004, [float("inf")] * 12, 1), (None, rows[0][1], 0), (2005, rows[0][1], None)]
    rows += [(2010 + i, [0.5, 0.25 * i, -1.0], i % 2) for i in range(12)]  # vectors of another length
    want = brute_mine(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(hard_negatives.mine(vectors(spark, rows), lambda i: i % 10 == 0)) == want
    # small blocks of lists and of queries, and a first round that sees little
    monkeypatch.setattr(hard_negatives, "LIST_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 9)
    monkeypatch.setattr(hard_negatives.InvertedLists.__init__, "__defaults__", (4,))
    assert read(hard_negatives.mine(vectors(spark, rows), lambda i: i % 10 == 0)) == want


def test_hard_negatives_scores_beyond_doubles(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1000 - 300) * 1e3 for j in range(3)], i % 3) for i in range(60)]
    rows[10] = (10, [9e5, -1e5, 7e5], 1)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, rows), lambda i: i % 10 == 0, scale=256.0).collect())
    assert got == brute_mine(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(vectors(spark, [(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1), (2, [5e8, 1e9], 0)]), lambda i: i % 10 == 0).collect()


def test_hard_negatives_of_little(spark):
    none = hard_negatives.mine(vectors(spark, [(1, [1.0], 1)]).limit(0), lambda i: i % 10 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    one_label = vectors(spark, [(i, [1.0, i / 9], 3) for i in range(20)])
    assert hard_negatives.mine(one_label, lambda i: i % 10 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [-0.5], 2)]), lambda i: i % 10 == 0).count() == 0  # a positive of negative score has no window


def test_bounds_hold(spark):
    rows = cloud(300)
    lists = hard_negatives.InvertedLists(vectors(spark, rows).selectExpr("vec_id as id", "cast(label as string) as label", "transform(embedding, x -> cast(floor(256 * x) as double)) as v"))
    names, n, _, centres, radii = lists.of[12]
    assert n.sum() == 300 and len(names) > 5
    for r in lists.lists.collect():
        c = list(names).index(r.cluster)
        assert np.linalg.norm(np.array(r.v) - centres[c]) <= radii[c]


# -- importance resampling -------------------------------------------------------------------


def brute_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))


def brute_resample(docs, target, orders, buckets=10_000, share=(10, 100), least=20, seed=2024):
    def grams(t):
        w = brute_words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(orders[0], orders[1] + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in grams(x)), Counter(b for x in target for b in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows, fit = [], []
    for k, (i, x) in enumerate(docs):
        g = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in grams(x)]
        w = sum(g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(brute_words(x)) >= least:
                fit.append((-score, i, len(g), k))
        rows.append([i, len(g), w, score, None])
    for rank, (*_, k) in enumerate(sorted(fit)[: share[0] * len(fit) // share[1]], 1):
        rows[k][4] = rank
    return sorted(map(str, map(tuple, rows)))


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "A1b2", "don't", "x_y"]
    return [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 60))).replace(" w1 ", ", W1.\n")) for i in range(n)]


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, "k", "b") for d in docs], "doc_id long, text string, row int, bucket string, score string")


@pytest.mark.parametrize("orders", [(1, 1), (1, 2), (2, 3)])
def test_resampling_against_brute_force(spark, orders):
    docs = [*corpus(), (500, None), (501, ""), (502, " . "), (503, "one"), (504, "word " * 30_000), (None, "w1 w2 w3 " * 10), (7, "another text of the same id " * 5), (9, "é" * 50_000)]
    target = ["w1 w2 w3 w4 w5", "w1 w2", None, ""]
    aim = spark.createDataFrame([(t, 3) for t in target], "text string, n int")
    got = resampling.resample(table(spark, docs), aim, orders=orders, share=(30, 100))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_resample(docs, target, orders, share=(30, 100))


def test_resampling_of_little(spark):
    docs, aim = table(spark, corpus(n=30)), spark.createDataFrame([("w1 w2",)], "text string")
    assert resampling.resample(docs.limit(0), aim).count() == 0
    got = resampling.resample(docs, aim.limit(0), orders=(1, 1))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_resample(corpus(n=30), [], (1, 1))
    twice = docs.unionByName(docs)
    ranks = sorted(r.rank for r in resampling.resample(twice, aim, share=(1, 2)).collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    drawn = resampling.draw(docs, aim, share=(1, 2))
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in resampling.resample(docs, aim, share=(1, 2)).collect() if r["rank"])
    with pytest.raises(ValueError, match="orders"):
        resampling.resample(docs, aim, orders=(0, 1))


# -- line dedup ------------------------------------------------------------------------------


def bare(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def brute_lines(docs, enough=3, least=20):
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(bare(line)) >= least:
                held[bare(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[bare(x)]) < enough or i == max(held[bare(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def pages(n=60, seed=1):
    rng = random.Random(seed)
    pool = [f"a line that many pages share, number {i}" for i in range(15)] + ["short", "", "  ", "EXACTLY TWENTY CHARS", "exactly nineteen ch", "Äußerst lange Zeile, ünïcode"]
    out = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line of page {i}, {rng.random()}" for _ in range(rng.randrange(1, 12))]
        out.append((i * 3, "\n".join(f"{rng.choice(['', ' ', chr(9)])}{x.upper() if rng.random() < 0.2 else x}" for x in lines)))
    return out


ODD = [(7, None), (8, ""), (10, "\n\n"), (None, "a line that many pages share, number 1"), (11, "line feed at the end of it\n"), (12, "line feed at the end of it\n"), (13, "line feed at the end of it"), (3, "a line that many pages share, number 2\nown"), (3, "a line that many pages share, number 2\nown")]


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 7}])
def test_line_dedup_against_brute_force(spark, how):
    docs = [*pages(), *ODD]
    df = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], "doc_id long, text string, key string, n int, top int")
    got = line_dedup.drop_repeated_lines(df, **how)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_lines(docs)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pulsegrid_run")]


def test_line_dedup_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(line_dedup, "small_side", lambda df: df.hint("merge"))
    docs = [*pages(seed=5), *ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in line_dedup.drop_repeated_lines(df).collect()) == brute_lines(docs)


def test_line_dedup_of_one_long_text(spark):
    def run(n):
        text = "\n".join(f"this line stands in three texts, {i}" for i in range(n))
        began = time.time()
        rows = line_dedup.drop_repeated_lines(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in rows) == [(0, n, n), (1, n, n), (2, n, 0)]
        return time.time() - began

    run(1000)
    short, long = run(10_000), run(80_000)
    assert long < 8 * short + 10


def test_runs_take_batches_in_any_order(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice(range(40)), rng.randrange(200)) for _ in range(600)})
    held = defaultdict(set)
    for k, i in rows:
        held[k].add(i)
    want = sorted((k, max(ids)) for k, ids in held.items() if len(ids) >= 12)
    df = spark.createDataFrame(rows, "k int, id long").selectExpr("cast(cast(k as string) as binary) as key", "id")
    for step in (1, -1):
        runs = line_dedup.LineRuns(spark, 12)
        sizes = []
        for b in range(0, 200, 20)[::step]:
            runs.add(df.where(f"id >= {b} and id < {b + 20}"))
            sizes.append(len(runs.names()))
        assert sizes == [1, 1, 2, 1, 2, 2, 3, 1, 2, 2] and len(runs.levels) == 4
        got = runs.repeated().collect()
        assert sorted((int(bytes(r.key)), r.top) for r in got) == want
        assert all(12 <= r.n <= len(held[int(bytes(r.key))]) for r in got)
        runs.close()


# -- many spans in one text ------------------------------------------------------------------


def test_many_spans_of_one_text(spark):
    def text(n, of):
        return " ".join(of.format(i=i) for i in range(n))

    def run(n):
        df = spark.createDataFrame([(1, text(n, "mail a{i}@b{i}.com to Mr. James Smith, é")), (2, "x" * (40 * n)), (3, None)], "doc_id long, text string")
        began = time.time()
        found = {r.doc_id: r for r in pii.find_pii(df).collect()}
        clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
        assert (found[1].n_email, found[1].n_other, found[2].n_email, found[3].n_email) == (n, n, 0, 0)
        assert clean == {1: text(n, "mail <EMAIL> to <NAME>, é"), 2: "x" * (40 * n), 3: None}
        starts = [int(x.split(":")[1]) for x in found[1].spans.split(",")]
        whole = text(n, "mail a{i}@b{i}.com to Mr. James Smith, é")
        assert [whole[s : s + 2] for s in starts[-2:]] == [f"a{n - 1}"[:2], "Mr"]
        return time.time() - began

    run(100)
    assert run(6000) < 4 * run(2000) + 5
