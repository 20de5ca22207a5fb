"""The pipeline against a brute-force version, and on odd tables."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from textwarden.llm import byte_bpe, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def copies_by_hand(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    return list(first.values())


def near_copies_by_hand(rows, percent=80):
    """One row of each connected group: that of the least identifier."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k) if sets[k] else ("alone", k), []).append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def holds_by_hand(text, item):
    """Whether a text holds 0.8 of the shingles of an item's question and of its answer, or of the whole item."""
    line, own = decontaminate.words(text), decontaminate.words(item)
    if not line or not own:
        return False
    share = lambda part: sum(any(tuple(line[k : k + len(s)]) == s for k in range(len(line))) for s in part) / len(part)
    parts = [share(decontaminate.shingles(p)) for p in decontaminate.parts(own)]
    return min(parts) >= 0.8 or (len(own) >= 10 and share(decontaminate.shingles(own)) >= 0.8)


def test_pipeline_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rated = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not rated[r.doc_id]]
    rows = near_copies_by_hand(copies_by_hand(rows))
    rows = [(i, t) for i, t in rows if not any(holds_by_hand(t, item) for item in items)]
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < docs.count()


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, extra=True):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # names that operators use inside
            docs = docs.withColumns({"node": F.lit(1), "keep_id": F.lit("x"), "text_sha256": F.lit(2.0), "score": F.lit(0), "block": F.lit(7), "comp": F.lit(None).cast("string")})
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30))), (None, "clean text"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_empty_tables(spark, folder):
    got = corpus_pipeline.run(spark, folder([]))
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "n_tokens"]


def test_nulls_repeats_and_clashing_names(spark, folder):
    item, long = " ".join(f"q{k}" for k in range(30)), " ".join(f"w{k}" for k in range(60))
    texts = [(None, "unnamed but clean"), (None, f"see {item}"), (None, None), (3, ""), (4, "same id one"), (4, "same id two"), (5, "twice the same"), (5, "twice the same"), (6, long), (7, long + " tail"), (None, long + " end"), (8, "x" * 300_000)]
    path = folder([(i, t, None, "s", None) for i, t in texts])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out
    left = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in docs.collect())
    assert left == sorted([(0, "unnamed but clean"), (3, ""), (4, "same id one"), (4, "same id two"), (5, "twice the same"), (6, long[:20]), (8, "x" * 20)])


def test_stages_begin_by_giving_memory_back(spark, folder, monkeypatch):
    """Stages share executors: what one leaves there would add to what the next one takes."""
    path, calls = folder([(1, "some text", None, "s", None), (2, "other text", None, "s", None)]), []
    docs = spark.read.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "collect_executors", calls.append)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path)
        assert calls == [spark] * (k + 1)
