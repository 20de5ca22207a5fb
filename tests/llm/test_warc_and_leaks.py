"""WARC round trips, decontamination, and the pipeline's guards."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, warc


def test_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (9, "u", ""), (4, "u", "z" * 300_000), (7, "u", "<p>é</p>"), (4, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("copies", F.lit(1)).repartition(3)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted(tuple(r) for r in warc.round_trip(spark, pages).collect()) == want
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (None, "u", "y")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, bytes(r.payload) if r.payload is not None else None) for r in warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}")).collect())
    assert got == [(0, "response", b"y"), (1, "response", b"x"), (2, "revisit", None)]


def test_members_and_damage():
    one, two = (warc.record_bytes(i, "u", b"body", warc.base32_sha1(b"body"), None, False) for i in (1, 2))
    assert [warc.parse(r)["page_id"] for r in warc.members(io.BytesIO(one + two))] == [1, 2]
    with pytest.raises(warc.BadArchive):
        list(warc.members(io.BytesIO(one + two[:-9])))
    raw = gzip.decompress(one)
    for bad in (raw.replace(b"body", b"bodx"), raw.replace(b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 5\r\n\r\nbody"), raw[:-1], b"x" + raw):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


def test_archives_of_others(spark, tmp_path):
    """Record types, digests and headers that our own writer doesn't make."""
    def record(kind, block, *lines):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:5f0a>", *lines, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: identity\r\n\r\nbody"
    hexed, based = hashlib.sha1(b"body").hexdigest(), warc.base32_sha1(b"body")
    data = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"),
        record("response", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{hexed}"), record("response", http, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{based}", "WARC-Block-Digest: md5:77"),
        record("metadata", b"{}", "Content-Type: application/json"), record("revisit", b"", "WARC-Refers-To: <urn:uuid:77>"), record("resource", b"raw bytes"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(data))
    got = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")).collect()
    assert [(r.record_type, r.page_id, r.url, None if r.payload is None else bytes(r.payload)) for r in got] == [
        ("warcinfo", None, None, b"software: x\r\n"), ("request", None, "http://a/", b""), ("response", None, None, b"body"), ("response", None, None, b"body"),
        ("metadata", None, None, b"{}"), ("revisit", None, None, None), ("resource", None, None, b"raw bytes"),
    ]
    with pytest.raises(warc.BadArchive):
        warc.parse(gzip.decompress(record("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "0" * 40)))


def leaks_by_hand(docs, items):
    out = set()
    for d, t in docs:
        line = decontaminate.words(t)
        for i, text in items:
            q, a = decontaminate.parts(decontaminate.words(text))
            if not line or not q:
                continue
            shares = [sum(any(tuple(line[k : k + len(s)]) == s for k in range(len(line))) for s in p) / len(p) for p in map(decontaminate.shingles, (q, a))]
            if min(shares) >= 0.8:
                out.add((d, i, *shares))
    return out


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = [f"t{k}" for k in range(300)] + ["the", "of", "and"] * 20
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randrange(12, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "tiny item"), (0, "repeated item text " * 5)]
    docs = [(i, line(rng.randrange(0, 400))) for i in range(60)] + [(200, None), (201, "")]
    for k in range(30):
        item = items[k % 40][1].upper().replace(" ", ", ") if k % 3 else items[k % 40][1]
        docs.append((300 + k, line(rng.randrange(150)) + " " + item + " " + line(rng.randrange(150))))
    docs.append((400, line(90) + " " + items[5][1][: len(items[5][1]) // 2] + " " + line(90)))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontaminate.find_leaks(table, bench).collect()}
    assert got == leaks_by_hand(docs, items) and len({g[0] for g in got} & set(range(300, 330))) == 30
    kept = decontaminate.drop_leaks(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {g[0] for g in got}
    assert decontaminate.find_leaks(table, bench.where("false")).count() == 0 and decontaminate.find_leaks(table.where("false"), bench).count() == 0


def test_leaks_with_a_changed_word():
    """One word replaced at every position, and a cut last word; half an item is no leak."""
    rng = random.Random(8)
    for n in (10, 11, 15, 16, 20, 24, 28, 29, 33, 59):
        item = [f"t{rng.randrange(400)}" for _ in range(n)]
        index = decontaminate.Index([(1, *decontaminate.parts([w.encode() for w in item]))], split=True)
        around = " ".join(f"u{k}" for k in range(90))
        lost = [i for i in range(n) if not index.leaks(f"{around} {' '.join([*item[:i], 'foreign', *item[i + 1 :]])} {around}")]
        assert not lost, (n, lost)
        assert index.leaks(f"{around} {' '.join(item[:-1])} {around}")
        assert not index.leaks(f"{around} {' '.join(item[: n // 2])} {around}")
        assert not index.leaks(" ".join(f"{w} {around}" for w in item))


def test_leaks_without_identifiers(spark):
    """A document without an identifier can't hide a leak, and a clean one stays."""
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(None, f"see {item} here", 1), (None, "clean text", 2), (1, None, 3), (1, item, 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (None, "clean text"), (8, None)], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 2)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}") for i in range(5)]
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, t in items], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(5)]


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(60))
    item = " ".join(f"q{k}" for k in range(30))
    bad = [(100 + i, f"x{i} vile y{i} vile") for i in range(12)]
    fine = [(200 + i, f"x{i} good y{i} nice") for i in range(12)]
    rows = [(1, long), (2, long.replace(" ", "  ")), (3, long + " extra"), (4, f"see {item} here"), (5, ""), *bad, *fine]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 200)) for i, _ in [*bad, *fine]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1 in got and not got & {2, 3, 4} and not got & {i for i, _ in bad}
    assert {i for i, _ in fine} <= got
