"""Documented cases of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textwarden.functions import patterns, text
from textwarden.operators import audit, build, decide, evaluate, leakage, report, segment
from textwarden.plans import scan

DETECTED = [
    ("mail a.b@ex.co now", [("EMAIL", "a.b@ex.co", 5, 14)]),
    ("call 0501234567", [("PHONE", "0501234567", 5, 15)]),
    ("id 123456789", [("ID", "123456789", 3, 12)]),
    ("acct 12345678 and 123456789", [("ID", "123456789", 18, 27), ("ACCOUNT", "12345678", 5, 13)]),
    ('pay 12,500 ש"ח', [("MONEY", '12,500 ש"ח', 4, 14)]),
    ('pay 12500 ש"ח', []),
    ("pay 500 שח", [("MONEY", "500 שח", 4, 10)]),
    ("see REQ-123456 or XREQ-123456", [("TICKET", "REQ-123456", 4, 14)]),
    ("use Temp2024! now", [("PASSWORD", "Temp2024!", 4, 13)]),
    ("API_KEY and secret-key", [("TECHNICAL_SECRET_KEYWORD", "API_KEY", 0, 7), ("TECHNICAL_SECRET_KEYWORD", "secret-key", 12, 22)]),
    ("jdbc:mysql://h", [("CONNECTION_STRING_KEYWORD", "jdbc:", 0, 5), ("CONNECTION_STRING_KEYWORD", "mysql://", 5, 13)]),
    ("jdbc: x", []),
    ("12345678901", []),
    ("🙂 12345678", [("ACCOUNT", "12345678", 2, 10)]),
    ("  ", []),
    (None, []),
]


def test_detectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DETECTED)], "i int, t string")
    got = {r.i: [(f["type"], f["value"], f["start"], f["end"]) for f in r.f or []] for r in df.select("i", patterns.findings(F.col("t")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(DETECTED)}


SEGMENTS = [
    ("Name: Dana", ["Name: Dana"]),
    ("• first item\n2) second item", ["• first item", "2) second item"]),
    ("This line wraps\nonto another line.", ["This line wraps", "onto another line."]),
    ("One here. Two here.", ["One here.", "Two here."]),
    ("One here. Two here", ["One here. Two here"]),
    ("at 10:30 we met", ["at 10:30 we met"]),
    ("***", ["***"]),
    ("", []),
    (None, []),
]


def test_segments(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SEGMENTS)], "i int, text string")
    got: dict[int, list[str]] = {i: [] for i in range(len(SEGMENTS))}
    for r in segment.text_units(df, ["i"]).orderBy("i", "unit_no").collect():
        got[r.i].append(r.sentence)
    assert got == {i: want for i, (_, want) in enumerate(SEGMENTS)}


def test_normalisation(spark):
    df = spark.createDataFrame([("a\r\nb  c\t d  \n\n\n\ne ,x שלום5 “q”",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_document(F.col("t"))).collect()] == ['a\nb c d\n\ne,x שלום 5 "q"', ""]
    df = spark.createDataFrame([("é x\t y ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_key(F.col("t"))).collect()] == ["é x y", ""]


TRUTH = [
    (True, "VALID_NON_LEAK", "COMPLETE", False, ("LEAK", "MEDIUM", "regex_deterministic", "COMPLETE")),
    (False, "VALID_LEAK", "COMPLETE", False, ("LEAK", "MEDIUM", "model_sequence", "COMPLETE")),
    (True, "VALID_LEAK", "COMPLETE", False, ("LEAK", "HIGH", "model_sequence", "COMPLETE")),
    (False, "VALID_NON_LEAK", "COMPLETE", False, ("NON_LEAK", "LOW", "model_sequence", "COMPLETE")),
    (False, "ERROR", "FAILED", True, ("UNDETERMINED", "UNKNOWN", "none", "FAILED")),
    (True, "ERROR", "PARTIAL", True, ("LEAK", "MEDIUM", "regex_deterministic", "PARTIAL")),
    (False, "INVALID_RESULT", "COMPLETE", False, ("UNDETERMINED", "UNKNOWN", "none", "FAILED")),
]


def test_decisions(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(TRUTH)], "i int, r boolean, v string, s string, e boolean")
    d = decide.decision(F.col("r"), F.col("v"), F.lit(0.8), F.lit(False), F.col("s"), F.col("e"))
    got = {r.i: (r.final_label, r.risk_level, r.confidence_source, r.analysis_status) for r in df.select("i", d.alias("d")).select("i", "d.*").collect()}
    assert got == {i: r[4] for i, r in enumerate(TRUTH)}


def test_python_scorer_turns_errors_into_rows(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise ValueError("bad")
            return [(0.0, 9.0) for _ in texts]

        return model

    good = scan.scan_documents(spark.createDataFrame([(1, "hello there")], "doc_id int, text string"), ["doc_id"], scan.python_scorer(load)).first()
    bad = scan.scan_documents(spark.createDataFrame([(1, "boom there")], "doc_id int, text string"), ["doc_id"], scan.python_scorer(load)).first()
    assert (good.leaks, good.document_status) == (1, "COMPLETE") and (bad.undetermined, bad.document_status) == (1, "FAILED")


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    r = evaluate.binary_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.recall) == (2, 1, 0, 1, 1.0)
    empty = evaluate.binary_metrics(df.where("label > 5")).first()
    assert empty.samples == 0 and empty.f1 == empty.mcc == empty.accuracy == 0


def test_ranks_and_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.2)], "label int, score double").withColumn("g", F.lit(1))
    assert evaluate.roc_auc(df, ["g"]).first().roc_auc == pytest.approx(2 / 3, abs=1e-6)
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, score double")
    sweep = evaluate.threshold_sweep(df)
    assert sweep.count() == 99
    best = evaluate.choose_threshold(sweep, 0.8, 0.25).first()
    assert (round(best.threshold, 2), best.rule) == (0.21, "STRICT_RECALL_AND_FPR")
    logits = spark.createDataFrame([(3.0, -3.0, 0), (-3.0, 3.0, 1), (2.0, -2.0, 0), (-2.0, 2.0, 1)], "z0 double, z1 double, label int")
    assert evaluate.fit_temperature(logits) > 0


def test_group_leakage_and_conflicts(spark):
    rows = [(1, "a", "train", False, "LEAK", "g1", "same\t text"), (2, "b", "calibration", True, "NON_LEAK", "g1", "same text"), (3, "b", "calibration", True, None, "", "other"), (4, "a", "train", False, None, None, None)]
    rec = audit.audit_records(spark.createDataFrame(rows, "seq int, file string, split string, protected boolean, label string, group_id string, text string").withColumn("category", F.lit("c")))
    assert [tuple(r) for r in audit.group_leakage(rec).collect()] == [("g1", 1, "train", 2, "calibration", "HIGH")]
    assert audit.label_conflicts(rec).count() == 1
    assert [(r.seq_a, r.file_b, r.copies_b) for r in audit.split_leakage(rec).collect()] == [(1, "b", 1)]
    assert leakage.option_a(rec).select("seq").collect()[0].seq == 4
    assert {r.overlap_type for r in leakage.protected_overlap(rec).collect()} == {"NORMALIZED_TEXT", "GROUP_ID"}


def test_option_b_takes_every_fifth_key(spark):
    rec = spark.createDataFrame([(i, k, "train", False, k) for i, k in enumerate("abcdefghijk")], "seq int, normalized_hash string, split string, protected boolean, group_id string")
    got = leakage.option_b(rec).where("new_split = 'validation'").select("group_id").collect()
    assert sorted(r[0] for r in got) == ["a", "f", "k"]


def test_merge_same_text(spark):
    t = spark.createDataFrame([(1, "h", "LEAK"), (2, "h", "LEAK")], "seq int, normalized_hash string, label string")
    s = spark.createDataFrame([(3, "h", "LEAK"), (4, "h", "NON_LEAK")], "seq int, normalized_hash string, label string")
    got = sorted((r.task, r.token_seq, r.sequence_seq) for r in build.merge_same_text(t, s).collect())
    assert got == [("both", 1, 3), ("sequence", None, 4), ("token", 2, None)]


def test_rect_lines(spark):
    rows = [(1, 100.0 - 5 * k, 10.0, 104.0 - 5 * k, 20.0) for k in range(10)] + [(2, 0.0, 10.0, 5.0, 20.0), (2, 0.0, 24.0, 5.0, 34.0)]
    got = sorted(tuple(r) for r in report.merge_lines(spark.createDataFrame(rows, "item long, x0 double, y0 double, x1 double, y1 double")).collect())
    assert got == [(1, 55.0, 10.0, 104.0, 20.0), (2, 0.0, 10.0, 5.0, 20.0), (2, 0.0, 24.0, 5.0, 34.0)]


def test_readers_and_writers(spark, tmp_path):
    from textwarden.sources import readers, writers

    (tmp_path / "train_a.jsonl").write_text('﻿{"text": "x", "label": "1"}\n\n{"text": "y"\n', encoding="utf-8")
    (tmp_path / "test_b.csv").write_text("text,label\na,1\nb,2,3\n")
    good, bad = readers.read_any(spark, str(tmp_path / "train_a.jsonl"), "text string, label string")
    assert [(r.text, r.line_no) for r in good.collect()] == [("x", 1)] and [(r.error, r.line_no) for r in bad.collect()] == [("MalformedJSON", 3)]
    with pytest.raises(Exception, match="bad JSON in .*train_a.jsonl:3"):
        readers.read_jsonl(spark, str(tmp_path / "train_a.jsonl"), "text string, label string", strict=True)[0].collect()
    good, bad = readers.read_any(spark, str(tmp_path / "test_b.csv"), "")
    assert [(r.text, r.line_no) for r in good.collect()] == [("a", 2)] and [r.line_no for r in bad.collect()] == [3]
    assert [p.rpartition("/")[2] for p in readers.discover(spark, str(tmp_path), ["train", "test"])] == ["test_b.csv", "train_a.jsonl"]
    writers.write_report(good.where("false").select("text"), str(tmp_path), "empty")
    assert [r.value for r in spark.read.text(str(tmp_path / "empty")).collect()] == ['"text"']
    assert {tuple(r) for r in writers.write_dataset({"train": good.select("text")}, str(tmp_path / "set")).collect()} == {("train", 1)}


def test_stream(spark, tmp_path):
    from textwarden.streaming import scan as stream

    spark.createDataFrame([(1, "id 123456789"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream.start(texts, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.doc_id, r.type) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "ID")]


def test_near_duplicates_in_a_large_block(spark):
    """A near copy of the last of 120 protected texts with one beginning is found."""
    from textwarden.operators import audit

    texts = [f"the same beginning of every text, number {k:04d}" for k in range(121)]
    rows = [(k, "test", True, t) for k, t in enumerate(texts[:120])] + [(500, "train", False, texts[119] + "!")]
    records = spark.createDataFrame([(*r, str(r[0])) for r in rows], "seq long, split string, protected boolean, normalized_text string, normalized_hash string")
    assert {(r.seq_a, r.seq_b) for r in audit.near_candidates(records).collect()} == {(500, k) for k in range(120)}
    assert audit.near_candidates(records, 50).count() == 50
    assert audit.near_duplicates(records).first().seq_b == 119


def near_records(spark, seed, letters):
    """One block of 90 training and 70 protected texts: near copies of a few bases, and unrelated ones, in two lengths."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    bases = [[word() for _ in range(n)] for n in (5, 45, 45, 46)]
    rows = []
    for k in range(160):
        words = list(rng.choice(bases)) if rng.random() < 0.6 else [word() for _ in range(rng.choice([5, 45]))]
        for _ in range(rng.randint(0, len(words) // 15)):
            words[rng.randrange(len(words))] = rng.choice(["", word()])
        rows.append((k, "train" if k < 90 else "test", k >= 90, "the same beginning " + " ".join(words)))
    records = spark.createDataFrame([(*r, r[3]) for r in rows], "seq long, split string, protected boolean, normalized_text string, normalized_hash string")
    return records, [(r.seq_a, r.seq_b, r.normalized_text_a, r.normalized_text_b) for r in records.transform(audit.near_candidates).collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_distances_of_a_block(spark):
    """Every pair of a block of several cells, held against plain distances; unrelated texts aren't compared in full."""
    records, pairs = near_records(spark, 1, "abcdeé🙂")
    got = {(r.seq_a, r.seq_b): r.score for r in audit.near_duplicates(records, native=True, top=None).collect()}
    scores = {(i, j): 1 - distance(a, b) / max(len(a), len(b)) for i, j, a, b in pairs}
    assert len(scores) > 1000 and got == {k: pytest.approx(v, abs=6e-5) for k, v in scores.items() if v >= 0.88} and 50 < len(got) < len(scores) / 2
    for _, _, a, b in pairs[:40]:
        d = distance(a, b)
        assert audit.bounded_distance(a, b, audit.char_places(b), d) == d and audit.bounded_distance(a, b, audit.char_places(b), d - 1) is None


def test_unrelated_texts_are_told_apart_by_their_runs(monkeypatch):
    import random

    rng = random.Random(3)
    texts = [(k, str(k), "".join(rng.choice("abcdefghij ") for _ in range(1000))) for k in range(40)]
    monkeypatch.setattr(audit, "bounded_distance", None)
    assert audit._near_distances(texts[:20], texts[20:], 0.88) == []


def test_near_ratios_of_a_block(spark):
    """Every pair of a block of several cells, and the first few, held against difflib."""
    import difflib

    records, pairs = near_records(spark, 2, [chr(k) for k in range(97, 197)])
    scores = {(i, j): difflib.SequenceMatcher(None, a, b).ratio() for i, j, a, b in pairs}
    want = sorted(((round(v, 4), i, j) for (i, j), v in scores.items() if v >= 0.88), key=lambda r: (-r[0], r[1], r[2]))
    assert len(want) > 100
    for top in (None, 7, 100):
        got = [(r.score, r.seq_a, r.seq_b) for r in audit.near_duplicates(records, top=top).collect()]
        assert sorted(got) == sorted(want) if top is None else got == want[:top]
    for _, _, a, b in pairs[:40]:
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert audit.common_length(a, b, audit.char_places(b), row[-1]) == row[-1] and audit.common_length(a, b, audit.char_places(b), row[-1] + 1) is None


def test_unrelated_texts_are_not_matched(monkeypatch):
    import random

    rng = random.Random(3)
    texts = [(k, str(k), "".join(rng.choice("abcdefghij ") for _ in range(1000))) for k in range(40)]
    monkeypatch.setattr(audit.difflib, "SequenceMatcher", None)
    assert audit._near_ratios(texts[:20], texts[20:], 0.88, 100, []) == []


def test_units_of_repeated_and_missing_keys(spark):
    """Pages with one key, or none, keep their lines apart."""
    rows = [(1, "first line here\nand more"), (1, "other doc line"), (None, "null key\ntwo"), (None, None), (2, " \n\n ")]
    got = sorted((r.i or 0, r.unit_no, r.sentence) for r in segment.text_units(spark.createDataFrame(rows, "i long, t string"), ["i"], "t").collect())
    assert got == [(0, 0, "null key"), (0, 1, "two"), (1, 0, "first line here"), (1, 0, "other doc line"), (1, 1, "and more")]
    plan = segment.text_units(spark.createDataFrame(rows, "i long, t string"), ["i"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_results_round_trip(spark, tmp_path):
    """What is written is read back as it was; pages without units stay; rows have all their columns."""
    import csv
    import json

    from textwarden.sources import readers, writers

    pages = spark.createDataFrame([("d1", 1, "mail a.b@example.com now.\nid 123456789"), ("d1", 2, ""), ("d1", 3, "nothing to see. At all."), ("d2", 1, None)], "doc string, page int, text string")
    results = scan.result_documents(pages, "doc", scorer=scan.rule_scorer)
    writers.write_results(results, str(tmp_path / "out"))
    back = readers.read_results(spark, str(tmp_path / "out/results_json"))
    plain = lambda df: sorted(json.dumps({k: v for k, v in json.loads(r[0]).items() if k != "document"}, sort_keys=True) for r in df.withColumn("metadata", F.col("metadata").dropFields("generated_at")).select(F.to_json(F.struct("*"))).collect())
    assert plain(back) == plain(results)
    doc = {r.document: r for r in results.collect()}
    assert [len(p.sentences) for p in doc["d1"].pages] == [2, 0, 2] and doc["d1"].summary.total_pages == 3 and doc["d1"].summary.total_sentences == 4
    assert doc["d2"].metadata.analysis_status == "COMPLETE" and doc["d2"].summary.total_sentences == 0
    first = doc["d1"].pages[0].sentences[0]
    assert first.regex_results[0].type == "EMAIL" and first.decision.final_label == "LEAK" and first.decision.sequence_support.status == "OK"
    marked = doc["d1"].pages[0].sentences[1]
    assert marked.token_analysis.results[0].value == "123456789" and marked.decision.token_support.span_count == 1 and "model_token_localization" in marked.decision.evidence_sources
    table = spark.read.option("header", True).csv(str(tmp_path / "out/results_csv"))
    assert table.columns == writers.RESULT_COLUMNS
    row = table.where("regex_types LIKE '%EMAIL%'").first().asDict()
    assert all(row[c] is not None for c in writers.RESULT_COLUMNS), row
    one = results.where("document = 'd1'")
    written = writers.save_document(one, str(tmp_path / "r.json"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes()[:3] == b"\xef\xbb\xbf" and written["schema_version"] == "2.0"
    assert next(csv.reader((tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines())) == writers.RESULT_COLUMNS
    assert readers.read_results(spark, str(tmp_path / "r.json")).select("summary.total_sentences").first()[0] == 4
    told = scan.public_summary(results).where("document = 'd1'").first()
    assert (told.status, told.pages, told.total_sentences, told.analysis_status) == ("success", 3, 4, "COMPLETE")
    for bad in ('{"schema_version": "1.0", "pages": []}', '{"schema_version": "2.0"}', '{"schema_version": "2.0", "pages": "x"}', '{"schema_version": "2.0", "pages": [{"page": 1}]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_results(spark, str(tmp_path / "bad.json"))
    summary = report.report_summary(readers.result_sentences(back), 2).first()
    assert summary.leak_sentences == 2 and summary.regex_findings == 2 and summary.token_sentences == 1 and summary.invalid_pages == 0


def test_command_line(spark, tmp_path, capsys):
    from textwarden.__main__ import main

    (tmp_path / "in.txt").write_text("id 123456789\fsecond page here.")
    got = main([str(tmp_path / "in.txt"), "--json", str(tmp_path / "o/r.json"), "--csv", str(tmp_path / "o/r.csv")])
    assert got["total_pages"] == 2 and got["total_leaks"] == 1 and "Leaks: 1" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        main([str(tmp_path / "none.txt")])
    (tmp_path / "in.doc").write_text("x")
    with pytest.raises(ValueError):
        main([str(tmp_path / "in.doc")])


def test_report_summary_counts_what_does_not_fit(spark):
    finding = "struct<type:string,value:string,start:int,end:int,source:string>"
    token = "struct<type:string,value:string,start:int,end:int,score:double>"
    schema = f"container_page int, sentence_page int, item struct<regex_results:array<{finding}>,token_analysis:struct<status:string,results:array<{token}>>,decision:struct<final_label:string,evidence_sources:array<string>,sequence_support:struct<validity:string,used_for_final_label:boolean>>>"
    item = lambda regex, tokens, label, sources, validity, used: (regex, ("OK", tokens), (label, sources, (validity, used)))
    good, bad = ("EMAIL", "a@b.cd", 0, 6, "regex"), ("ID", "x", 0, 1, "regex")
    span, broken = ("P", "ab", 0, 2, 0.9), ("P", "ab", 2, 2, 0.9)
    rows = [
        (1, 1, item([good, bad], [span, broken], "LEAK", ["model_sequence"], "VALID_LEAK", True)), (2, 3, item([], [], "LEAK", ["model_sequence"], "ERROR", False)),
        (None, 9, item([good], [], "LEAK", [], "VALID_LEAK", True)), (1, 1, item([good], [span], "NON_LEAK", [], "VALID_NON_LEAK", False)),
    ]
    got = report.report_summary(spark.createDataFrame(rows, schema), 3).first()
    assert (got.leak_sentences, got.regex_findings, got.invalid_regex_findings, got.token_sentences, got.invalid_token_findings, got.sequence_sentences) == (3, 2, 1, 1, 1, 2)
    assert got.invalid_pages == 2 and {x.reason for x in got.not_found_examples} == {"mismatch", "out_of_range"} and len(got.warnings) == 1


def test_typed_rows(spark, tmp_path):
    from textwarden.sources import readers

    (tmp_path / "s.jsonl").write_text('\ufeff{"text": "a", "label": "SAFE"}\n\n{"text": "b", "sequence_label": "1.0", "case_id": "c7", "category": "X"}\n')
    rows = readers.sequence_rows(readers.read_jsonl(spark, str(tmp_path / "s.jsonl"), readers.SEQUENCE_SCHEMA)[0])
    assert [(r.row_id, r.text, r.label, r.label_name, r.category, r.difficulty) for r in rows.orderBy("line_no").collect()] == [("1", "a", 0, "NON_LEAK", "UNKNOWN", "unknown"), ("c7", "b", 1, "LEAK", "X", "unknown")]
    (tmp_path / "bad.jsonl").write_text('{"text": " ", "label": "1"}\n')
    with pytest.raises(Exception, match="missing text in .*, line 1"):
        readers.sequence_rows(readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), readers.SEQUENCE_SCHEMA)[0]).collect()
    (tmp_path / "t.jsonl").write_text('{"tokens": ["a", "b"], "ner_tags": [0, 1]}\n{"tokens": ["a"], "ner_tags": [0], "document_label": "LEAK", "id": "z"}\n')
    rows = readers.token_rows(readers.read_jsonl(spark, str(tmp_path / "t.jsonl"), readers.TOKEN_SCHEMA)[0]).orderBy("line_no").collect()
    assert [(r.row_id, r.text, r.ner_tags, r.document_label) for r in rows] == [("1", "a b", [0, 1], None), ("z", "a", [0], 1)]
    (tmp_path / "u.jsonl").write_text('{"tokens": ["a", "b"], "ner_tags": [0]}\n')
    with pytest.raises(Exception, match="don't fit"):
        readers.token_rows(readers.read_jsonl(spark, str(tmp_path / "u.jsonl"), readers.TOKEN_SCHEMA)[0]).collect()
    (tmp_path / "l.csv").write_text("segment,text\nx,\ny,z\nq\n")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "l.csv")).orderBy("line_no").collect()] == ["x", "z", "q"]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.read_config(spark, str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.read_config(spark, str(tmp_path / "c.json"))
    import hashlib

    assert readers.file_digests(spark, str(tmp_path / "c.json")).first().sha256 == hashlib.sha256(b"[1]").hexdigest()
    assert readers.named_path("a=b/c.txt") == ("a", "b/c.txt") and readers.named_path("b/c.txt") == ("c", "b/c.txt")
    spark.createDataFrame([("B-X", 1), ("O", 0)], "label string, label_id int").createOrReplaceTempView("l1")
    other = spark.createDataFrame([("B-Y", 1), ("O", 0)], "label string, label_id int")
    assert {(r.side, r.label) for r in build.schema_differences(spark.table("l1"), other).collect()} == {("missing", "B-X"), ("unexpected", "B-Y")}


def test_lines_of_many_tasks_are_numbered(spark, tmp_path):
    from textwarden.sources import readers

    (tmp_path / "big.txt").write_text("".join(f"line {k} {'x' * 50}\n" for k in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        got = readers.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert got.rdd.getNumPartitions() > 3 and got.where("line NOT LIKE concat('line ', line_no, ' %')").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_settings_are_checked():
    assert scan.checked_settings("2.5", 0.5, 1) == (2.5, 0.5, 1.0)
    for bad in ((True, 0.5, 0.5), (0, 0.5, 0.5), (float("nan"), 0.5, 0.5), (1, 1, 0.5), (1, 0, 0.5), (1, 0.5, 1.1), (1, 0.5, None)):
        with pytest.raises(ValueError):
            scan.checked_settings(*bad)


def test_python_scorer_spans_and_errors(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise KeyError("bad")
            return [(0.0, 9.0, [("P", t[:2], 0, 2, 0.8)]) for t in texts]

        return model

    good = scan.scan_units(spark.createDataFrame([(1, "hello there")], "doc_id int, text string"), ["doc_id"], scan.python_scorer(load, name="m1")).first()
    assert good.tokens[0].value == "he" and good.token_support.max_score == 0.8 and good.scored_by == "m1" and "model_token_localization" in good.evidence_sources
    bad = scan.scan_units(spark.createDataFrame([(1, "boom there")], "doc_id int, text string"), ["doc_id"], scan.python_scorer(load)).first()
    assert (bad.status, bad.errors[0].error_type, bad.analysis_status, bad.final_label) == ("ERROR", "KeyError", "FAILED", "UNDETERMINED")


def test_calibration_and_evaluation(spark):
    logits = spark.createDataFrame([(2.0, -2.0, 0), (1.0, -1.0, 0), (-2.0, 2.0, 1), (-1.0, 1.0, 1), (0.5, -0.5, 1)], "z0 double, z1 double, label int")
    record, sweep = evaluate.calibration_record(logits, "m", "set", 0.5, 0.5)
    row = record.first()
    assert record.count() == 1 and sweep.count() == 99 and row.model == "m" and row.temperature > 0 and row.selection_rule == "STRICT_RECALL_AND_FPR" and row.recall >= 0.5
    units = spark.createDataFrame([("call 123456789012", 1), ("plain words", 1), ("more words", 0)], "sentence string, label int").withColumn("findings", F.array().cast("array<struct<type:string>>"))
    metrics, errors = evaluate.evaluate_scorer(units, scan.rule_scorer)
    got = metrics.first()
    assert (got.tp, got.fn, got.tn) == (1, 1, 1) and [r.sentence for r in errors.collect()] == ["plain words"]


def test_splits_that_meet_raise(spark):
    part = lambda h, g: spark.createDataFrame([(h, g)], "normalized_hash string, group_id string")
    build.assert_isolated({"a": part("1", "g"), "b": part("2", None)})
    with pytest.raises(ValueError, match="a-b:group_id"):
        build.assert_isolated({"a": part("1", "g"), "b": part("2", "g")})


def test_token_payload_and_distribution(spark):
    rows = spark.createDataFrame([(1, "x y", ["x", "y"], [0, 1], ["O", "B-P"], None, "token", 1)], "seq int, text string, tokens array<string>, ner_tags array<int>, tag_names array<string>, typed_spans array<string>, task string, sequence_label int")
    got = build.canonical_records(rows, "token", "train", "src").first()
    assert got.id == "train_token_0000000" and got.payload.ner_tags == [0, 1]
    with pytest.raises(Exception, match="don't fit"):
        build.canonical_records(rows.withColumn("ner_tags", F.array(F.lit(1))), "token", "train", "src").collect()
    told = build.distribution(rows).first()
    assert told.entity_types == {"P": 1} and told.sequence_labels == {"LEAK": 1} and told.min_length == 3


def test_protected_patterns_come_back(spark):
    lines = ["mail a.b@ex.co or www.x.org/p?q=1.5 at 12:30", "on 1/2/2024 and 3.5 or 1,250.75", "C:\\dir\\file.txt and http://h.org/a.b", "none here", "", "10:20 10:20 a.b.co 7.7 x@y.zz"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("t", segment.protect(F.col("t")).alias("p"))
    got = rows.select("t", "p.text", "p.values", segment.restore(F.col("p.text"), F.col("p.values")).alias("back")).collect()
    assert all(r.back == r.t for r in got)
    assert all("@" not in r.text and ":" not in r.text and "." not in r.text for r in got) and sum(len(v) for r in got for v in r["values"]) == 14


def test_counts_of_a_stream(spark, tmp_path):
    """Findings per window of event time."""
    import datetime as dt

    from textwarden.streaming import scan as stream

    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, "id 123456789", at(1)), (2, "id 123456789 and a@b.cd", at(4)), (3, "id 987654321", at(14)), (4, None, at(15))]
    spark.createDataFrame(rows, "doc_id long, text string, at timestamp").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    query = stream.counts_stream(texts, "at").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.window_start.minute, r.type, r.n) for r in spark.table("counted").collect()} == {(0, "ID", 2), (0, "EMAIL", 1), (10, "ID", 1)}


def test_environment_sets_paths(monkeypatch):
    from textwarden.session import configured

    assert configured("model", "models/x") == "models/x"
    monkeypatch.setenv("TEXTWARDEN_MODEL", "/m")
    assert configured("model", "models/x") == "/m"


def test_label_schema_and_manifest(spark, tmp_path):
    from textwarden.sources import readers, writers

    (tmp_path / "l.json").write_text('{"labels": ["O", "B-P", "I-P"]}')
    labels = readers.read_label_schema(spark, str(tmp_path / "l.json"))
    assert [(r.label_id, r.label, r.prefix, r.entity_type) for r in labels.orderBy("label_id").collect()] == [(0, "O", None, None), (1, "B-P", "B", "P"), (2, "I-P", "I", "P")]
    (tmp_path / "none.json").write_text("{}")
    assert [r.label for r in readers.read_label_schema(spark, str(tmp_path / "none.json")).collect()] == ["O"]
    writers.write_dataset({"train": labels}, str(tmp_path / "set"), labels)
    assert readers.read_label_schema(spark, str(tmp_path / "set/label_schema")).count() == 3
    files = spark.createDataFrame([("a", "MULTITASK_TRAIN_TOKEN_SOURCE", False), ("b", "MULTITASK_VALIDATION_TOKEN_SOURCE", False), ("c", "CALIBRATION_ONLY", True), ("d", "UNKNOWN", False)], "file string, role string, protected boolean")
    assert [r.use for r in audit.manifest(files, 0).orderBy("file").collect()] == ["TRAIN", "VALIDATION", "EVALUATION", "EXCLUDED"]
    assert {r.use for r in audit.manifest(files, 1).collect()} == {"EXCLUDED"}
    writers.write_reports({"files": files, "none": files.where("false")}, str(tmp_path / "reports"), "A title")
    assert [r.value for r in spark.read.text(str(tmp_path / "reports/summary.txt")).collect()] == ["A title", "files: 4 rows", "none: 0 rows"]
    assert writers.json_safe(files).count() == 4


def test_dataset_info_counts_values(spark):
    rows = [(1, "f", "LEAK", "c1", "g", "x y", ["text", "a"]), (2, "f", "LEAK", None, "", "x y", ["text"]), (3, "f", None, "c1", "g", "", ["b"])]
    rec = audit.audit_records(spark.createDataFrame(rows, "seq int, file string, label string, category string, group_id string, text string, fields array<string>"))
    bad = spark.createDataFrame([("f", 4)], "file string, line_no int")
    got = audit.dataset_info(rec, bad).first()
    assert got.label_counts == {"LEAK": 2, "MISSING": 1} and got.category_counts == {"c1": 2, "MISSING": 1} and got.fields == ["a", "b", "text"]
    assert (got.groups, got.malformed_count, got.sample_text_preview, got.empty) == (1, 1, "x y", 1)


def test_signatures(spark):
    """Records of one text conflict where their spans differ."""
    spans = "array<struct<start:int,end:int,type:string,text:string>>"
    rows = [(1, "t", "LEAK", ["B-P"], [(0, 1, "P", "t")]), (2, "t", "LEAK", ["B-P"], [(0, 1, "P", "t")]), (3, "t", "LEAK", ["B-S"], None)]
    df = spark.createDataFrame(rows, f"seq int, text string, label string, labels array<string>, spans {spans}").withColumns({"file": F.lit("f"), "signature": audit.signature(F.col("labels"), F.col("spans"))})
    pairs = audit.duplicate_pairs(audit.audit_records(df), "exact_hash").collect()
    assert {(r.seq_a, r.seq_b, r.conflict) for r in pairs} == {(1, 2, False), (1, 3, True), (2, 3, True)}
    assert {(r.seq_a, r.seq_b) for r in audit.label_conflicts(audit.audit_records(df)).collect()} <= {(1, 3), (2, 3)}
