"""Token shards and byte-level BPE against the public libraries."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textwarden.llm import byte_bpe, token_store

ODD = ["", None, " ", "  a  b", "a\n b \n\n c  d\x1c e", "x" * 1000, "ab" * 300, "<|endoftext|> hi", "né 漢字 🙂🙂 12 3'll don't", "\t tab", "a b c", "end ", " lead", "end\n", "\nfirst", "a\nb c.\nd,e f. g", "é, ü.", "word, word. word"]
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(["the", "Worth,", "thanedble.", "éeuxan", "2024", "a\nb"]) for _ in range(rng.randrange(200)))) for i in range(40)] + [(5, "again")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)


def test_shards_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = lambda t: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    got = sorted(token_store.round_trip(spark, docs, P.path("byte_bpe_50k.json")).collect(), key=lambda r: (r.start, r.n_tokens))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    want = sorted((r.doc_id, len(encode(r.text)) // 4, zlib.crc32(encode(r.text))) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_store.round_trip(spark, docs.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_encoder_of_marks_and_a_full_cache(monkeypatch):
    """Words with any marks behind them cost no call of their own, texts of now survive a full cache, one thread encodes."""
    import os

    from tokenizers import Tokenizer

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    e, tk = token_store.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    rng = random.Random(4)
    tails = ["", "", ".", ",", "!!", "$$$", "'", "'.", ".'s", "'s", "''ll", "_", "_a", "\"?!", "-", "...", ".1", "²"]
    texts = [rng.choice(" \n").join(rng.choice(["the", "é", "x1", "漢字", "Don't", ""]) + rng.choice(tails) or "z" for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    want = [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want
    asked, whole = [], e.whole
    monkeypatch.setattr(e, "whole", lambda t: asked.extend(t) or whole(t))
    assert e.encode(["the$$$!? the_"]) == whole(["the$$$!? the_"]) and asked == ["$$$!?"]
    monkeypatch.setattr(token_store, "CACHE", 3)
    assert e.encode(texts[:5]) == want[:5] and len(e.known) < 150 and len(asked) < 30 and e.encode(texts) == want


def test_null_identifiers_come_first(spark):
    """Rows without an identifier, repeated ones and clashing names."""
    rows = spark.createDataFrame([(2, "b"), (None, "a b"), (None, None), (2, "b"), (1, None)], "doc_id long, text string").withColumns({"shard": F.lit(1), "start": F.lit("x")})
    got = sorted(token_store.round_trip(spark, rows, P.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2] and sorted(r.n_tokens for r in got[:2]) == [1, 3]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def test_reader_touches_only_the_frames_it_needs(tmp_path):
    path = tmp_path / "x.ids.zst"
    with open(path, "wb") as f:
        w = token_store.ShardWriter(f, frame_bytes=64)
        for i in range(50):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    r = token_store.ShardReader(f"file://{path}")
    assert len(r.frames) > 5
    seen = []
    whole = r.frame
    r.frame = lambda k: seen.append(k) or whole(k)
    assert dict(r.read({7, 30})) == {i: np.arange(i, dtype="<u4").tobytes() for i in (7, 30)} and len(seen) == 2
    data = bytearray(path.read_bytes())
    data[r.at[seen[0]] + 12] ^= 0xFF
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):  # noqa: B017  zstandard's or our own
        list(token_store.ShardReader(f"file://{path}").read())


def test_bpe_round_trip(docs):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = [tuple(r) for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert byte_bpe.round_trip(docs.where("false"), RANKS, P.PATTERN).count() == 0


def test_heap_merge_is_the_fold():
    import tiktoken

    ranks = byte_bpe.load_ranks(RANKS)
    pairs = byte_bpe.pair_ranks(ranks)
    e = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcthe ") for _ in range(rng.randrange(1, 60)))
        assert byte_bpe.heap_merge([ranks[bytes([b])] for b in word.encode()], pairs) == e.encode_ordinary(word)


def test_rank_map_finds_every_pair(spark):
    """Both places are tried; pairs that can't merge give null."""
    rng = random.Random(4)
    pairs = {(rng.randrange(5000), rng.randrange(5000)): 5000 + k for k in range(3000)}
    ranks = byte_bpe.RankMap(pairs)
    rows = [(a, b, r) for (a, b), r in pairs.items()] + [(a, b, None) for a, b in ((rng.randrange(5000), rng.randrange(5000)) for _ in range(3000)) if (a, b) not in pairs] + [(-1, 3, None), (3, None, None)]
    df = spark.createDataFrame(rows, "a long, b long, r long")
    found = F.get(F.transform(F.array(ranks.column()), lambda t: ranks.rank(t, F.col("a"), F.col("b"))), F.lit(0))
    assert df.where(~found.eqNullSafe(F.col("r"))).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.RankMap({(1 << 20, 1): 5})
