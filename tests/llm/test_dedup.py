"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textwarden.llm import exact_dedup, graph, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, segment int, run int, keep_id long"


def table(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "é", "iota"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  two"), (105, "a b"), (106, words(rng, 30_000))]
    base = words(rng, 120)
    for k in range(60):  # near copies at many distances
        w = base.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8, 15])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((200 + k, " ".join(w)))
    passage = words(rng, 20)
    for k in range(60):  # a shared passage isn't a near copy
        rows.append((300 + k, words(rng, rng.randrange(1, 60)) + " " + passage))
    rows += [(1000 + k, rows[rng.randrange(len(rows))][1]) for k in range(40)]
    rng.shuffle(rows)
    return rows


def test_exact_dedup(spark, monkeypatch):
    rows = [*corpus(), (7, "twice"), (7, "twice"), (None, "nobody"), (None, "twice")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        same = groups[norm(t)]
        keep = min((x for x in same if x is not None), default=None)
        want.append((i, keep, len(same), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for bits, pieces in ((1, 10), (4, 1_000_000)):
        monkeypatch.setattr(exact_dedup, "LEVEL_BITS", bits)
        monkeypatch.setattr(exact_dedup, "FAN_IN", 1 << bits)
        monkeypatch.setattr(exact_dedup, "PIECE_ROWS", pieces)
        got = exact_dedup.exact_dedup(table(spark, rows).repartition(7)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_survivors_keep_columns(spark):
    df = table(spark, [(2, "a  b"), (1, "a b"), (3, None)])
    got = exact_dedup.survivors(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def test_runs_arrive_sorted_and_keep_the_least():
    """Merges refuse runs out of order; entries that differ in length or second digest stay apart."""
    def run(*entries):
        out = np.zeros(len(entries), exact_dedup.ROW)
        for i, (sha, size, check, none, keep) in enumerate(entries):
            out[i] = ((sha, 0, 0, 0), size, check, none, keep, 1, 1)
        return out

    one, two = run((1, 5, 5, 0, 9), (2, 5, 5, 1, 0), (2, 6, 5, 0, 4)), run((1, 5, 5, 0, 3), (2, 5, 5, 0, 8), (3, 1, 1, 1, 0))
    assert exact_dedup.in_order(one) and not exact_dedup.in_order(one[::-1])
    got = exact_dedup.merged([one, two])
    assert exact_dedup.in_order(got)
    assert [(int(r["sha"][0]), int(r["n_bytes"]), int(r["none"]), int(r["keep_id"]), int(r["group_size"]), int(r["keep_rows"])) for r in got] == [(1, 5, 0, 3, 2, 1), (2, 5, 0, 8, 2, 1), (2, 6, 0, 4, 1, 1), (3, 1, 1, 0, 1, 1)]
    bad = pa.Table.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([one[::-1].tobytes()], pa.binary())], schema=exact_dedup.RUN)
    with pytest.raises(ValueError):
        exact_dedup._merge(bad)


def test_exact_survivors_without_proper_identifiers(spark):
    df = table(spark, [(None, "only  null"), (None, "only null"), (7, "two texts"), (7, "other text"), (7, "other  text"), (8, "other text"), (9, "two texts"), (3, None), (None, "")])
    got = sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in exact_dedup.survivors(df).collect())
    assert got == [(0, "only null"), (3, ""), (7, "other text"), (7, "two texts")]


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that clusters and their cells are reached
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    monkeypatch.setattr(near_dedup, "VERIFY_BYTES", 5000)
    rows = corpus(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, rows), percent).collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize("local", [0, 500_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    chain = [(i, i + 1) for i in range(100, 130)] + [(7, 3), (3, 7), (5, 5), (3, 9), (None, 4)] + [(1000, k) for k in range(500, 600)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {3: 3, 7: 3, 9: 3} | {k: 500 for k in [*range(500, 600), 1000]}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_nothing(spark):
    df = table(spark, [(1, "x")])
    assert near_dedup.near_duplicates(df.where("false")).count() == 0
    assert near_dedup.survivors(df.where("false")).count() == 0
    got = near_dedup.near_duplicates(table(spark, [(None, "a b c"), (5, "a b c"), (6, None), (None, "alone here"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (0, 0, False), (0, 5, False), (5, 5, True), (6, 6, True)]


def test_repeated_identifiers_keep_their_links(spark):
    """Rows with one identifier and different texts are linked each for itself, and one row of each group stays."""
    rng = random.Random(12)
    a, b, c, alone = (words(rng, 90) for _ in range(4))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (None, c), (None, c + " end"), (9, alone), (9, alone), (None, ""), (None, None), (9, " "), (30, "x y"), (31, "X  y")]
    df = table(spark, rows)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.near_duplicates(df).collect()))
    assert [(i, k) for i, n, k in got if i in (5, 6, 7)] == [(5, 5), (5, 5), (6, 5), (7, 5)]
    kept = near_dedup.survivors(df)
    assert kept.columns == df.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [t for t in texts if t[0] in (5, 6, 7)] == sorted([(5, a), (5, b)])
    assert len([t for t in texts if t[1].startswith(c)]) == 1 and texts.count((9, alone)) == 1
    assert texts.count((0, "")) == 2 and (9, " ") in texts and (30, "x y") in texts and len(texts) == 8


def test_recall_against_brute_force(spark):
    """All links of whole tables: the components of sf0.001."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 85).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 85)
    print("recall", sum(got[i] == want[i] for i in want) / len(want))
    assert got == want


def test_estimate_is_near_the_truth():
    rng = random.Random(4)
    a = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    b = a[:2600] + [f"v{rng.randrange(10**6)}" for _ in range(400)]
    s, t = near_dedup.shingle_set(" ".join(a)), near_dedup.shingle_set(" ".join(b))
    true = len(set(s.tolist()) & set(t.tolist())) / len(set(s.tolist()) | set(t.tolist()))
    x, y = (near_dedup.registers(v)[None] for v in (s, t))
    assert abs(float(near_dedup.estimates(x, y)[0][0]) - true) < 0.15
