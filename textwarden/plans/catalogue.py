"""The query catalogue: every operator over the driver's tables, with the same query in SQL where SQL can say it.

documents stand for dataset records: source is the file (src0 to src13 train, src14 to src16 validation, the others
protected), lang the category, labels.toxic the gold label. conversations stand for grouped records: conv_id is the
group, the turn deals rows to splits. events stand for scored predictions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import patterns, text
from textwarden.operators import audit, build, decide, evaluate, leakage, report, segment
from textwarden.plans import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = _docs(spark, sf_dir).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("file"), "text", F.col("lang").alias("category"), F.lit(None).cast("string").alias("group_id"),
        F.when(number <= 13, "train").when(number <= 16, "validation").otherwise("calibration").alias("split"), (number >= 17).alias("protected"),
        F.when(F.col("toxic") == 1, "LEAK").when(F.col("toxic") == 0, "NON_LEAK").alias("label"),
    )
    return audit.audit_records(rows)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 4
    rows = _t(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("part"), turn).alias("file"), "text", F.col("role").alias("category"), F.col("conv_id").cast("string").alias("group_id"),
        F.when(turn <= 1, "train").when(turn == 2, "validation").otherwise("calibration").alias("split"), (turn == 3).alias("protected"), F.when(F.col("role") == "user", "LEAK").otherwise("NON_LEAK").alias("label"),
    )
    return audit.audit_records(rows)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions: the score is the value's share of 100 to three digits, the label a purchase."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.col("value") / F.lit(100.0), 3)))
    return _t(spark, sf_dir, "events").select("event_type", (F.col("event_type") == "purchase").cast("int").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))


def _values(rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


REC = """rec AS (SELECT d.doc_id AS seq, d.source AS file, d.text, d.lang AS category, CAST(NULL AS VARCHAR) AS group_id,
    CASE WHEN sn <= 13 THEN 'train' WHEN sn <= 16 THEN 'validation' ELSE 'calibration' END AS split, sn >= 17 AS protected,
    CASE l.toxic WHEN 1 THEN 'LEAK' WHEN 0 THEN 'NON_LEAK' END AS label,
    trim(regexp_replace(nfc_normalize(coalesce(d.text, '')), '\\s+', ' ', 'g')) AS normalized_text, sha256(coalesce(d.text, '')) AS exact_hash,
    sha256(trim(regexp_replace(nfc_normalize(coalesce(d.text, '')), '\\s+', ' ', 'g'))) AS normalized_hash
    FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS sn FROM documents) d LEFT JOIN labels l USING (doc_id))"""
GRP = """rec AS (SELECT conv_id * 1000 + turn AS seq, 'part' || CAST(turn % 4 AS VARCHAR) AS file, text, role AS category, CAST(conv_id AS VARCHAR) AS group_id,
    CASE WHEN turn % 4 <= 1 THEN 'train' WHEN turn % 4 = 2 THEN 'validation' ELSE 'calibration' END AS split, turn % 4 = 3 AS protected,
    CASE WHEN role = 'user' THEN 'LEAK' ELSE 'NON_LEAK' END AS label, sha256(coalesce(text, '')) AS exact_hash,
    sha256(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'))) AS normalized_hash FROM conversations)"""
SCO = """sco AS (SELECT event_type, CAST(event_type = 'purchase' AS INT) AS label, least(1.0, greatest(0.0, round(value / 100.0, 3)))::DOUBLE AS score FROM events),
    pre AS (SELECT *, CAST(score >= 0.5 AS INT) AS prediction FROM sco)"""
NORM = r"""nrm AS (SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(
    regexp_replace(translate(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)),
    '\n{3,}', chr(10) || chr(10), 'g'), '\s+([,;.!?؟])', '\1', 'g'), ' ' || chr(10)) AS t FROM documents)"""
LINES = NORM + r""", lin AS (SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM nrm WHERE t <> '')))"""
LISTED = r"'^([•●▪▫◦‣⁃]\s+|([0-9]+|[A-Za-z]|[א-ת])\s*[.)]\s+)'"
ENDED = r"""'[.!?؟…]["'')\]}״׳]*$'"""
LABELLED = r"'^[^;?!؟:]*[^;?!؟:\s.…][^;?!؟:]*[:：]\s*\S'"
FEAT = LINES + rf""", len1 AS (SELECT doc_id, list_sort(list(length(line))) AS a FROM lin WHERE line <> '' GROUP BY 1),
    sta AS (SELECT doc_id, list_median(a) AS median_length, list_median(list_slice(a, 1, greatest(1, len(a) // 2))) AS lower_length FROM len1),
    nei AS (SELECT *, last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_line,
        first_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line,
        coalesce(lag(line) OVER w, '') = '' AS previous_blank, coalesce(lead(line) OVER w, '') = '' AS next_blank FROM lin WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    fea AS (SELECT nei.*, median_length::DOUBLE AS median_length, lower_length::DOUBLE AS lower_length, regexp_matches(line, {LABELLED}) AS is_label, regexp_matches(line, {LISTED}) AS is_list,
        regexp_matches(line, {ENDED}) AS ends_sentence, regexp_matches(line, '^[^\pL\pN]+$') AS only_marks FROM nei JOIN sta USING (doc_id))"""
KIND = FEAT + rf""", kin AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN is_label THEN 'metadata' WHEN is_list THEN 'list_item'
        WHEN NOT ends_sentence AND NOT only_marks AND length(line) <= lower_length AND (previous_blank OR next_blank OR (next_line IS NOT NULL AND (length(next_line) > length(line)
            OR regexp_matches(next_line, {LABELLED}) OR regexp_matches(next_line, {LISTED}))) OR (previous_line IS NULL AND next_line IS NOT NULL)) THEN 'heading' ELSE 'body' END AS kind FROM fea)"""
BLOCK = KIND + r""", isl AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT *,
        kind <> 'body' OR coalesce(lag(kind) OVER w <> 'body' OR lag(ends_sentence) OVER w, true) AS opens FROM kin WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))),
    blk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_no, block FROM (SELECT doc_id, island,
        regexp_replace(string_agg(CASE WHEN k > 1 AND NOT hyphen THEN ' ' || body ELSE body END, '' ORDER BY line_no), '\s+', ' ', 'g') AS block FROM (SELECT doc_id, island, line_no, row_number() OVER w AS k,
            coalesce(regexp_matches(lag(line) OVER w, '[-־]$'), false) AS hyphen, CASE WHEN lead(line) OVER w IS NOT NULL THEN regexp_replace(line, '[-־]+$', '') ELSE line END AS body FROM isl WHERE kind <> 'blank'
            WINDOW w AS (PARTITION BY doc_id, island ORDER BY line_no)) GROUP BY 1, 2) WHERE block <> '')"""
UNIT = BLOCK + rf""", prt AS (SELECT doc_id, block_no, i, trim(p[i]) AS sentence FROM (SELECT doc_id, block_no, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, block_no,
        CASE WHEN regexp_matches(block, {LABELLED}) OR regexp_matches(block, {LISTED}) OR NOT regexp_matches(block, {ENDED}) THEN [block]
        ELSE list_filter(string_split(regexp_replace(block, '([.!?؟…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' AND NOT regexp_matches(x, '^[^\pL\pN]+$')) END AS p FROM blk))),
    uni AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, i) - 1 AS unit_no, sentence FROM prt WHERE sentence <> '')"""
MAIL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'"
FIND = rf""", hit AS (SELECT doc_id, unit_no, 'EMAIL' AS type, unnest(regexp_extract_all(sentence, {MAIL})) AS value FROM uni
    UNION ALL SELECT doc_id, unit_no, CASE WHEN length(v) = 9 THEN 'ID' WHEN regexp_matches(sentence, '\b' || v || '\b') AND regexp_matches(v, '^05[0-9]{{8}}$') THEN 'PHONE' ELSE 'ACCOUNT' END, v
        FROM (SELECT doc_id, unit_no, sentence, unnest(regexp_extract_all(sentence, '[0-9]+')) AS v FROM uni) WHERE length(v) BETWEEN 8 AND 10)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.text_units(_docs(spark, sf_dir), ["doc_id"])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _docs(spark, sf_dir).select("doc_id", text.normalize_document(F.col("text")).alias("text")).where("text <> ''")
    return segment.line_features(clean, ["doc_id"])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_units(_docs(spark, sf_dir), ["doc_id"])


# Text.


@query(f"WITH {NORM} SELECT doc_id, t AS text FROM nrm")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.normalize_document(F.col("text")).alias("text"))


@query(f"WITH {REC} SELECT seq, exact_hash, normalized_hash FROM rec")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("seq", "exact_hash", "normalized_hash")


@query(f"WITH {REC} SELECT seq, CASE WHEN length(normalized_text) > 120 THEN substr(normalized_text, 1, 120) || '...' ELSE normalized_text END AS preview FROM rec")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), text.preview(F.col("text")).alias("preview"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unnamed') AS name FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(r"SELECT conv_id, turn, len(list_distinct([trim(text, ' ' || chr(10)), trim(regexp_replace(text, '\s+', ' ', 'g')), trim(replace(text, chr(10), ' '))])) AS variants FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''")
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").where(text.strip(F.col("text")) != "")
    return rows.select("conv_id", "turn", F.size(text.search_variants(F.col("text"))).cast("long").alias("variants"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lin")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _docs(spark, sf_dir).select("doc_id", text.normalize_document(F.col("text")).alias("text")).where("text <> ''")
    return segment.line_records(clean, ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {FEAT} SELECT doc_id, median_length, lower_length FROM fea GROUP BY ALL")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", "median_length", "lower_length").distinct()


@query(f"WITH {FEAT} SELECT doc_id, line_no, previous_line, next_line, previous_blank, next_blank FROM fea")
def line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "previous_line", "next_line", "previous_blank", "next_blank")


@query(f"WITH {FEAT} SELECT doc_id, line_no, is_label, is_list, ends_sentence, only_marks FROM fea")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "is_label", "is_list", "ends_sentence", "only_marks")


@query(f"WITH {KIND} SELECT doc_id, line_no, kind FROM kin")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind")


@query(f"WITH {BLOCK} SELECT doc_id, block_no, block FROM blk")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _docs(spark, sf_dir).select("doc_id", text.normalize_document(F.col("text")).alias("text"))
    return segment.blocks(clean, ["doc_id"]).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "block")


@query(r"SELECT conv_id, turn, len(list_filter(string_split(regexp_replace(text, '([.!?؟…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' AND NOT regexp_matches(x, '^[^\pL\pN]+$'))) AS sentences FROM conversations")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(segment.split_sentences(F.col("text"))).cast("long").alias("sentences"))


@query(r"SELECT conv_id, turn, CAST(ceil(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) / 30.0) AS BIGINT) AS chunks FROM conversations")
def token_budget_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(segment.token_chunks(F.col("text"), 32)).cast("long").alias("chunks"))


@query(f"WITH {UNIT} SELECT doc_id, unit_no, sentence FROM uni")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "sentence")


# Detectors and decisions.


@query(f"WITH {UNIT} {FIND} SELECT doc_id, unit_no, type, value FROM hit")
def regex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _units(spark, sf_dir).select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), F.explode(patterns.findings(F.col("sentence"))).alias("f"))
    return found.select("doc_id", "unit_no", "f.type", "f.value")


@query(f"WITH {UNIT} {FIND} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM hit GROUP BY 1")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _units(spark, sf_dir).select("doc_id", F.explode(patterns.findings(F.col("sentence"))).alias("f"))
    return found.groupBy(F.col("f.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(r"""WITH p AS (SELECT doc_id, string_split_regex(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS v FROM documents),
    e AS (SELECT doc_id, g, v, unnest(range(1, len(v) + 1)) AS i FROM p)
    SELECT doc_id, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_at FROM e WHERE length(v[i]) = 9""")
def finding_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, pattern = patterns.PATTERNS[2]
    found = _docs(spark, sf_dir).select("doc_id", F.explode(patterns.matches(F.col("text"), pattern, kind)).alias("f"))
    return found.select("doc_id", "f.value", F.col("f.start").cast("long").alias("start_at"))


@query(f"WITH {UNIT} {FIND}, h AS (SELECT DISTINCT doc_id, unit_no, true AS f FROM hit) SELECT doc_id, unit_no, CASE WHEN f THEN 'LEAK' ELSE 'UNDETERMINED' END AS final_label, CASE WHEN f THEN 'MEDIUM' ELSE 'UNKNOWN' END AS risk_level, CASE WHEN f THEN 0.99::DOUBLE END AS confidence_value, CASE WHEN f THEN 'regex_deterministic' ELSE 'none' END AS confidence_source, CASE WHEN f THEN 'COMPLETE' ELSE 'FAILED' END AS analysis_status FROM uni LEFT JOIN h USING (doc_id, unit_no)")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "final_label", "risk_level", "confidence_value", "confidence_source", "analysis_status")


@query(f"""WITH {UNIT} {FIND}, h AS (SELECT DISTINCT doc_id, unit_no, true AS f FROM hit), j AS (SELECT doc_id, count(*) AS total, count(f) AS leaks FROM uni LEFT JOIN h USING (doc_id, unit_no) GROUP BY 1)
    SELECT doc_id, coalesce(total, 0) AS total, coalesce(leaks, 0) AS leaks, coalesce(total - leaks, 0) AS undetermined, coalesce(leaks, 0) AS medium,
    CASE WHEN total IS NULL OR leaks = total THEN 'COMPLETE' WHEN leaks = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS document_status FROM documents LEFT JOIN j USING (doc_id)""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_documents(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", "total", "leaks", "undetermined", "medium", "document_status")


JUDGED = f"""WITH {UNIT} {FIND}, hn AS (SELECT doc_id, unit_no, count(*) AS n FROM hit GROUP BY ALL), sc AS (SELECT doc_id, unit_no, sentence, coalesce(n, 0) AS n, length(sentence) - length(regexp_replace(sentence, '[0-9]', '', 'g')) AS d, length(sentence) AS l FROM uni LEFT JOIN hn USING (doc_id, unit_no)),
    pr AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(n * 4.0::DOUBLE + 10.0::DOUBLE * d / l - 5.0::DOUBLE) / {scan.TEMPERATURE}::DOUBLE)) AS p FROM sc), ju AS (SELECT *, p >= {scan.THRESHOLD}::DOUBLE AS leak, n > 0 AS hit FROM pr)"""


@query(f"""{JUDGED}, su AS (SELECT doc_id, count(*) AS total, count(*) FILTER (leak OR hit) AS leaks, count(*) FILTER (NOT leak AND NOT hit) AS non_leaks, count(*) FILTER (leak AND hit) AS high, count(*) FILTER (leak <> hit) AS medium FROM ju GROUP BY 1)
    SELECT doc_id, coalesce(total, 0) AS total, coalesce(leaks, 0) AS leaks, coalesce(non_leaks, 0) AS non_leaks, 0::BIGINT AS undetermined, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(non_leaks, 0) AS low, 0::BIGINT AS unknown,
    coalesce(total, 0) AS complete, 0::BIGINT AS partial, 0::BIGINT AS failed, 'COMPLETE' AS document_status FROM documents LEFT JOIN su USING (doc_id)""")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all counters of every document, with the rule scorer."""
    return scan.scan_documents(_docs(spark, sf_dir), ["doc_id"], scan.rule_scorer)


@query(f"""{JUDGED} SELECT '2.0' AS schema_version, doc_id AS page, sentence, 'COMPLETE' AS analysis_status, CASE WHEN leak OR hit THEN 'LEAK' ELSE 'NON_LEAK' END AS final_label, CASE WHEN leak AND hit THEN 'HIGH' WHEN leak OR hit THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN leak THEN round(p, 6) WHEN hit THEN 0.99 ELSE round(1 - p, 6) END AS confidence_value, CASE WHEN hit AND NOT leak THEN 'regex_deterministic' ELSE 'model_sequence' END AS confidence_source, CAST(n AS INT) AS findings,
    'OK' AS sequence_status, CASE WHEN leak THEN 'LEAK' ELSE 'NON_LEAK' END AS sequence_label, CAST(leak AS INT) AS sequence_prediction, round(CASE WHEN leak THEN p ELSE 1 - p END, 6) AS sequence_confidence, round(p, 9) AS sequence_probability_leak, {scan.TEMPERATURE}::DOUBLE AS sequence_temperature, {scan.THRESHOLD}::DOUBLE AS sequence_threshold,
    'rule' AS sequence_source, CASE WHEN leak THEN 'VALID_LEAK' ELSE 'VALID_NON_LEAK' END AS sequence_validity, len(list_filter(regexp_extract_all(sentence, '[0-9]+'), lambda x: length(x) >= 5)) AS marked, '[]' AS model_errors FROM ju""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rows of every unit; lists are given by their sizes."""
    from textwarden.sources.writers import flat_rows

    units = scan.scan_units(_docs(spark, sf_dir), ["doc_id"], scan.rule_scorer).withColumn("page", F.col("doc_id"))
    rows = flat_rows(units).withColumns({"findings": F.json_array_length("regex_types"), "marked": F.json_array_length("token_types").cast("long"), "sequence_probability_leak": F.round("sequence_probability_leak", 9)})
    return rows.drop("reasons", "evidence_sources", "regex_types", "regex_values", "token_status", "token_types", "token_values", "token_scores")


PATTERN_TEXTS = [
    "write to dana.k@example.co.il or a+b@x.org today", "call 0521234567 or 0612345678", "ids 123456789 and 1234567890 and 12345678", "paid 1,250.50 ש\"ח and 99 שח but 5 שקל", "see REQ-123456 and HR-12345 and FIN-654321",
    "login Dana2024! or x123! now", "the API_KEY and access-token and secretkey", "jdbc:mysql and connection string or DATABASE URL", "postgres://db x mongodb:// y", "accounts 87654321 and 123456789 and 0529876543", "nothing here", "  ", "",
]


def _pattern_hits() -> str:
    kinds = {
        "EMAIL": MAIL, "PHONE": r"'\b05[0-9]{8}\b'", "TICKET": r"'\b(?:REQ|INC|SR|HR|FIN)-[0-9]{6}\b'", "PASSWORD": r"'\b[A-Za-z]+[0-9]{4,}!'",
        "TECHNICAL_SECRET_KEYWORD": r"'(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|refresh[_-]?token|private[_-]?key)\b'",
        "CONNECTION_STRING_KEYWORD": r"'(?i)\b(?:connection\s*string|database\s*url|db[_-]?url|jdbc:|mongodb://|postgres://|mysql://)\b'",
    }
    plain = " UNION ALL ".join(f"SELECT i, '{k}' AS type, unnest(regexp_extract_all(t, {p})) AS value FROM tx" for k, p in kinds.items())
    money = r"""SELECT i, 'MONEY', unnest(regexp_extract_all(t, '(?:^|[^0-9])([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:ש["״]?ח|שח))', 1)) FROM tx"""
    return f"""tx AS (SELECT * FROM (VALUES {_values(list(enumerate(PATTERN_TEXTS)))}) AS x(i, t)), ru AS (SELECT i, unnest(regexp_extract_all(t, '[0-9]+')) AS v FROM tx), ph AS (SELECT i, unnest(regexp_extract_all(t, '\\b05[0-9]{{8}}\\b')) AS v FROM tx),
        hi AS ({plain} UNION ALL {money} UNION ALL SELECT i, 'ID', v FROM ru WHERE length(v) = 9 UNION ALL SELECT i, 'ACCOUNT', v FROM ru WHERE length(v) IN (8, 10) AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.i = ru.i AND ph.v = ru.v))"""


@query(f"WITH {_pattern_hits()} SELECT i, type, value, count(*) AS n FROM hi GROUP BY ALL")
def inline_pattern_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine detectors, on texts made for them."""
    rows = spark.sql(f"SELECT * FROM VALUES {_values(list(enumerate(PATTERN_TEXTS)))} AS x(i, t)")
    return rows.select("i", F.explode(patterns.findings(F.col("t"))).alias("f")).groupBy("i", "f.type", "f.value").agg(F.count(F.lit(1)).alias("n"))


LABEL_LINES = ["Name: Dana", "time 12:30 today", "see http://a.b/c now", "Ends here. then: no", "a; b: c", "only:", ": only", "Total： 5", "what? x: y", "net (a: b", "Ratio 3:45:10 x", "Note - subject: text", "plain"]


@query(f"SELECT i, i IN (0, 3, 7, 9, 11) AS is_label FROM (VALUES {_values(list(enumerate(LABEL_LINES)))}) AS t(i, line)")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(list(enumerate(LABEL_LINES)))} AS t(i, line)")
    return rows.select("i", segment.is_label_value(F.col("line")).alias("is_label"))


STATES = [("OK", "LEAK", "1", "0.9", "0.3"), ("OK", "LEAK", "1", "0.2", "0.3"), ("OK", "NON_LEAK", "0", "0.3", "0.3"), ("OK", "NON_LEAK", "0", "0.1", "0.3"), ("OK", "LEAK", "0.9", "0.9", "0.3"), ("ERROR", None, None, None, None), ("NOT_RUN", "LEAK", "1", "0.9", "0.3"), ("OK", "LEAK", "1", "NaN", "0.3"), ("OK", "LEAK", "1", "0.9", "1.5"), (None, None, None, None, None)]
STATE_SQL = f"s AS (SELECT * FROM (VALUES {_values([(i, *r) for i, r in enumerate(STATES)])}) AS t(i, status, label, prediction, p, h))"


def _states(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values([(i, *r) for i, r in enumerate(STATES)])} AS t(i, status, label, prediction, p, h)")


VALIDITY_SQL = """v AS (SELECT i, status, CASE WHEN status = 'ERROR' THEN 'ERROR' WHEN coalesce(status, '') <> 'OK' THEN 'NOT_RUN' WHEN y = 1 AND label = 'LEAK' AND pd >= hd THEN 'VALID_LEAK'
    WHEN y = 0 AND label = 'NON_LEAK' AND pd < hd THEN 'VALID_NON_LEAK' ELSE 'INVALID_RESULT' END AS validity, pd FROM (SELECT *, CAST(trunc(TRY_CAST(prediction AS DOUBLE)) AS INT) AS y,
    CASE WHEN TRY_CAST(p AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(p AS DOUBLE) END AS pd, CASE WHEN TRY_CAST(h AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(h AS DOUBLE) END AS hd FROM s))"""


@query(f"WITH {STATE_SQL}, {VALIDITY_SQL} SELECT i, validity FROM v")
def sequence_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark).select("i", decide.sequence_validity(*(F.col(c) for c in ("status", "label", "prediction", "p", "h"))).alias("validity"))


@query(f"""WITH {STATE_SQL}, {VALIDITY_SQL} SELECT i, r, CASE WHEN r OR validity = 'VALID_LEAK' THEN 'LEAK' WHEN validity = 'VALID_NON_LEAK' THEN 'NON_LEAK' ELSE 'UNDETERMINED' END AS final_label,
    array_to_string(list_filter([CASE WHEN r THEN 'regex' END, CASE WHEN validity = 'VALID_LEAK' THEN 'model_sequence' END], lambda x: x IS NOT NULL), '+') AS evidence FROM v, (VALUES (true), (false)) AS b(r)""")
def evidence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark).withColumn("r", F.explode(F.array(F.lit(True), F.lit(False))))
    validity = decide.sequence_validity(*(F.col(c) for c in ("status", "label", "prediction", "p", "h")))
    fused = decide.decision(F.col("r"), validity, decide.finite(F.col("p")), F.lit(False), F.lit("COMPLETE"), F.lit(False))
    return rows.select("i", "r", fused.alias("d")).select("i", "r", "d.final_label", F.array_join("d.evidence_sources", "+").alias("evidence"))


@query("SELECT event_id, round(1.0 / (1.0 + exp((value / 10.0 - 5.0) / 2.5)), 6) AS p FROM events")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.round(evaluate.calibrated(F.col("value") / F.lit(10.0), F.lit(5.0), 2.5), 6).alias("p"))


ERRORS = [(1, "token", "m", "RuntimeError", "a"), (1, "sequence", "m", "RuntimeError", "a"), (1, "token", "m", "RuntimeError", "a"), (2, "token", "m", "ValueError", "b")]


@query(f"SELECT DISTINCT i, component, source, error_type, message FROM (VALUES {_values(ERRORS)}) AS t(i, component, source, error_type, message)")
def merge_model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(ERRORS)} AS t(i, component, source, error_type, message)")
    lists = rows.groupBy("i").agg(F.collect_list(F.struct("component", "source", "error_type", "message")).alias("e"))
    return lists.select("i", F.explode(decide.merge_errors(F.col("e"), F.col("e"))).alias("e")).select("i", "e.*")


COUNTS = [(0, 0, 0), (2, 2, 0), (2, 1, 0), (2, 1, 1), (2, 0, 2), (2, 0, 0)]


@query(f"SELECT total, complete, failed, CASE WHEN total = 0 THEN 'COMPLETE' WHEN failed = total THEN 'FAILED' WHEN complete = total THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (VALUES {_values(COUNTS)}) AS t(total, complete, failed)")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values(COUNTS)} AS t(total, complete, failed)").withColumn("status", decide.document_status(F.col("total"), F.col("complete"), F.col("failed")))


METADATA = [(1, 0, "OK", "VALID_LEAK", "NaN", "0.4"), (1, 1, "OK", "VALID_LEAK", "6.2", "0.4"), (1, 2, "OK", "VALID_LEAK", "2.0", "0.1"), (2, 0, "ERROR", "ERROR", "1.0", "0.5"), (2, 1, "OK", "VALID_LEAK", "0", "0.4"), (3, 0, "OK", "INVALID_RESULT", "1.0", "0.5"), (3, 1, "OK", "VALID_NON_LEAK", "1.5", "0.25")]


@query(f"""WITH m AS (SELECT doc, unit_no, TRY_CAST(t AS DOUBLE) AS t, TRY_CAST(h AS DOUBLE) AS h FROM (VALUES {_values(METADATA)}) AS x(doc, unit_no, status, validity, t, h)
    WHERE status = 'OK' AND validity IN ('VALID_LEAK', 'VALID_NON_LEAK') AND NOT isnan(TRY_CAST(t AS DOUBLE)) AND TRY_CAST(t AS DOUBLE) > 0), f AS (SELECT doc, arg_min(t, unit_no) AS temperature, arg_min(h, unit_no) AS threshold FROM m GROUP BY 1)
    SELECT doc, temperature, threshold FROM (SELECT unnest([1, 2, 3]) AS doc) LEFT JOIN f USING (doc)""")
def first_valid_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(METADATA)} AS x(doc, unit_no, status, validity, temperature, threshold)")
    return decide.first_valid_metadata(rows, ["doc"])


# Audit.


def _pairs_sql(key: str, limit: int = 200) -> str:
    return f"""WITH {REC}, p AS (SELECT a.seq AS seq_a, b.seq AS seq_b, coalesce(a.label <> b.label, false) AS conflict, row_number() OVER (PARTITION BY a.{key} ORDER BY a.seq, b.seq) AS k
        FROM rec a JOIN rec b ON a.{key} = b.{key} AND a.seq < b.seq) SELECT seq_a, seq_b, conflict FROM p WHERE k <= {limit}"""


@query(_pairs_sql("exact_hash"))
def exact_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(_records(spark, sf_dir), "exact_hash").select("seq_a", "seq_b", "conflict")


@query(_pairs_sql("normalized_hash"))
def normalized_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(_records(spark, sf_dir), "normalized_hash").select("seq_a", "seq_b", "conflict")


@query(_pairs_sql("normalized_hash", 2))
def bounded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(_records(spark, sf_dir), "normalized_hash", 2).select("seq_a", "seq_b", "conflict")


@query(f"""WITH {REC}, l AS (SELECT * FROM rec WHERE label IS NOT NULL), p AS (SELECT a.seq AS seq_a, b.seq AS seq_b, a.label <> b.label AS conflict, row_number() OVER (PARTITION BY a.normalized_hash ORDER BY a.seq, b.seq) AS k
    FROM l a JOIN l b ON a.normalized_hash = b.normalized_hash AND a.seq < b.seq) SELECT seq_a, seq_b FROM p WHERE k <= 50 AND conflict""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_conflicts(_records(spark, sf_dir)).select("seq_a", "seq_b")


@query(f"""WITH {REC}, h AS (SELECT normalized_hash, file AS file_b, min(seq) AS seq_b, count(*) AS copies_b FROM rec WHERE protected GROUP BY ALL)
    SELECT r.seq AS seq_a, file AS file_a, seq_b, file_b, copies_b, 'HIGH' AS severity FROM rec r JOIN h USING (normalized_hash) WHERE split = 'train' AND NOT protected""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_leakage(_records(spark, sf_dir)).drop("key")


@query(f"""WITH {GRP}, p AS (SELECT a.group_id, a.seq AS seq_a, a.split AS split_a, b.seq AS seq_b, b.split AS split_b, CASE WHEN (a.split = 'train' AND b.protected) OR (b.split = 'train' AND a.protected) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    row_number() OVER (PARTITION BY a.group_id ORDER BY a.seq, b.seq) AS k FROM rec a JOIN rec b ON a.group_id = b.group_id AND a.seq < b.seq AND a.split <> b.split) SELECT * EXCLUDE (k) FROM p WHERE k <= 20""")
def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.group_leakage(_grouped(spark, sf_dir))


@query(f"""WITH {REC}, t AS (SELECT normalized_hash, regexp_matches(text, '[0-9]') AS has_entities, count(*) AS token_rows FROM rec WHERE split = 'train' GROUP BY ALL),
    s AS (SELECT normalized_hash, label, count(*) AS sequence_rows FROM rec WHERE label IS NOT NULL GROUP BY ALL), c AS (SELECT normalized_hash FROM s GROUP BY 1 HAVING count(*) > 1)
    SELECT normalized_hash, has_entities, label, token_rows, sequence_rows, CASE WHEN c.normalized_hash IS NOT NULL THEN 'CONFLICT_REVIEW_REQUIRED' WHEN has_entities = (label = 'LEAK') THEN 'CONSISTENT' ELSE 'POSSIBLY_VALID_DIFFERENCE' END AS classification
    FROM t JOIN s USING (normalized_hash) LEFT JOIN c USING (normalized_hash)""")
def cross_task_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    labelled = rec.where("label IS NOT NULL")
    mixed = labelled.groupBy("normalized_hash").agg(F.countDistinct("label").alias("n")).where("n > 1")
    tokens = rec.where("split = 'train'").withColumn("entity_count", F.col("text").rlike("[0-9]").cast("int"))
    return audit.cross_task_overlaps(tokens, labelled, mixed)


NEAR = f"""{REC}, lo AS (SELECT normalized_hash, normalized_text, split, protected, min(seq) AS seq, substr(normalized_text, 1, 16) AS p, length(normalized_text) // 40 AS b FROM rec WHERE length(normalized_text) >= 20 GROUP BY ALL),
    hd AS (SELECT * FROM lo WHERE protected),
    nr AS (SELECT t.seq AS seq_a, h.seq AS seq_b, t.normalized_text AS ta, h.normalized_text AS tb FROM lo t JOIN hd h ON t.p = h.p AND h.b BETWEEN t.b - 1 AND t.b + 1 AND t.normalized_hash <> h.normalized_hash WHERE t.split = 'train' AND NOT t.protected)"""


@query(f"WITH {NEAR} SELECT seq_a, seq_b FROM nr")
def near_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_candidates(_records(spark, sf_dir)).select("seq_a", "seq_b")


# DuckDB's distance counts bytes, so each distinct character of a pair becomes one byte first.
@query(f"""WITH {NEAR}, ch AS (SELECT *, list_distinct(string_split(ta || tb, '')) AS c FROM nr), cd AS (SELECT *, array_to_string(c, '') AS f, array_to_string(list_transform(range(1, len(c) + 1), lambda i: chr(CAST(i AS INT))), '') AS t FROM ch),
    di AS (SELECT seq_a, seq_b, levenshtein(translate(ta, f, t), translate(tb, f, t)) AS d, greatest(length(ta), length(tb)) AS n FROM cd)
    SELECT seq_a, seq_b, round(1.0 - d::DOUBLE / n, 4) AS score FROM di WHERE 1.0 - d::DOUBLE / n >= 0.88""")
def near_duplicate_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_duplicates(_records(spark, sf_dir), native=True, top=None)


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_duplicates(_records(spark, sf_dir))


@query(f"""WITH {REC} SELECT file, count(*) AS records, count(DISTINCT category) AS categories, count(exact_hash) - count(DISTINCT exact_hash) AS exact_duplicates, count(normalized_hash) - count(DISTINCT normalized_hash) AS normalized_duplicates,
    count(*) FILTER (normalized_text = '') AS empty, count(*) FILTER (label = 'LEAK') AS leaks, count(*) FILTER (label = 'NON_LEAK') AS non_leaks FROM rec GROUP BY 1""")
def dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inventory(_records(spark, sf_dir))


@query(f"WITH {REC}, c AS (SELECT file, coalesce(label, 'MISSING') AS value, count(*) AS n FROM rec GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY file), 4)::DOUBLE AS percentage FROM c")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(_records(spark, sf_dir), "label")


@query(f"WITH {REC}, c AS (SELECT split AS file, coalesce(category, 'MISSING') AS value, count(*) AS n FROM rec GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY file), 4)::DOUBLE AS percentage FROM c")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(_records(spark, sf_dir).withColumn("file", F.col("split")), "category")


TAGGED = [(1, "O B-P I-P O B-S"), (2, "B-P O B-P"), (3, "O O"), (4, "I-S X")]


@query(f"""WITH t AS (SELECT seq, unnest(string_split(tags, ' ')) AS t FROM (VALUES {_values(TAGGED)}) AS x(seq, tags)) SELECT regexp_replace(t, '^[BI]-', '') AS type, count(*) AS labels, count(DISTINCT seq) AS records FROM t WHERE t <> 'O' GROUP BY 1""")
def entity_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(TAGGED)} AS x(seq, tags)")
    return audit.entity_types(rows.select("seq", F.split("tags", " ").alias("tag_names")))


@query(f"""WITH {REC}, r AS (SELECT file, length(normalized_text) AS len, row_number() OVER (PARTITION BY file ORDER BY length(normalized_text)) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM rec)
    SELECT file, max(n) AS n, min(len) AS min_len, max(len) AS max_len, round(avg(len), 4) AS mean_len, round(median(len), 4)::DOUBLE AS median_len, min(len) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, min(len) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99 FROM r GROUP BY 1""")
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_statistics(_records(spark, sf_dir))


NAMES = ["a_train_v1.jsonl", "hard_train_test.jsonl", "x_validation.csv", "x_dev.csv", "x_development.jsonl", "calibration_set.jsonl", "hard_challenge.jsonl", "final_blind.csv", "real_world_test.csv", "unit_TEST.jsonl", "other.jsonl", "old_token_classification_1.jsonl", "seq_v2.jsonl", "known.jsonl"]
NAME_SQL = f"nm AS (SELECT * FROM (VALUES {_values([(x,) for x in NAMES])}) AS t(name))"
SPLIT_SQL = """sp AS (SELECT name, CASE WHEN n LIKE '%train%' THEN 'train' WHEN n LIKE '%validation%' OR (n LIKE '%dev%' AND n NOT LIKE '%development%') THEN 'validation' WHEN n LIKE '%calibration%' THEN 'calibration' WHEN n LIKE '%development%' THEN 'development'
    WHEN n LIKE '%challenge%' THEN 'challenge' WHEN n LIKE '%blind%' THEN 'blind' WHEN n LIKE '%real_world_test%' THEN 'real_world_test' WHEN n LIKE '%test%' THEN 'test' ELSE 'unknown' END AS split,
    n NOT LIKE '%hard_train%' AND regexp_matches(n, 'calibration|development|challenge|blind|test') AS protected FROM (SELECT name, lower(name) AS n FROM nm))"""


@query(f"""WITH {NAME_SQL}, {SPLIT_SQL}, ta AS (SELECT *, unnest(['token', 'sequence']) AS task FROM sp) SELECT name, task, split, protected, CASE WHEN name = 'known.jsonl' THEN 'FINAL_BLIND_TEST_ONLY' WHEN protected AND split IN ('test', 'development') THEN 'INTERNAL_TEST_ONLY'
    WHEN protected AND split IN ('challenge', 'real_world_test') THEN 'HARD_TEST_ONLY' WHEN protected THEN 'PROTECTED_EVALUATION' WHEN task = 'token' AND name LIKE '%token_classification%' THEN 'SUPERSEDED' WHEN task = 'sequence' AND name LIKE '%\\_v2.jsonl' ESCAPE '\\' THEN 'BASELINE_REFERENCE_ONLY' ELSE 'UNKNOWN' END AS role FROM ta""")
def dataset_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.sql(f"SELECT * FROM VALUES {_values([(x,) for x in NAMES])} AS t(name)").withColumn("task", F.explode(F.array(F.lit("token"), F.lit("sequence"))))
    rows = names.select("name", "task", audit.infer_split(F.col("name")).alias("split"), audit.is_protected(F.col("name")).alias("protected"))
    return rows.withColumn("role", audit.propose_role(F.col("name"), F.col("task"), F.col("split"), F.col("protected"), {"known.jsonl": "FINAL_BLIND_TEST_ONLY"}))


LABEL_ROWS = [("LEAK",), ("non_leak",), ("1",), ("0",), ("SAFE",), ("NON-LEAK",), ("1.0",), ("true",), ("",), (None,)]


@query(f"""WITH v AS (SELECT upper(trim(x)) AS x FROM (VALUES {_values(LABEL_ROWS)}) AS t(x)) SELECT x, CASE WHEN x IN ('LEAK', '1') THEN 'LEAK' WHEN x IN ('NON_LEAK', '0') THEN 'NON_LEAK' END AS audit,
    CASE WHEN x IN ('LEAK', '1') THEN 'LEAK' WHEN x IN ('NON_LEAK', 'NON-LEAK', '0') THEN 'NON_LEAK' END AS build, CASE WHEN x IN ('LEAK', 'SENSITIVE', '1', '1.0') THEN 'LEAK' WHEN x IN ('NON_LEAK', 'NON-LEAK', 'SAFE', '0', '0.0') THEN 'NON_LEAK' END AS evaluate FROM v""")
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT upper(trim(x)) AS x FROM VALUES {_values(LABEL_ROWS)} AS t(x)")
    return rows.select("x", *(text.binary_label(v, F.col("x")).alias(v) for v in ("audit", "build", "evaluate")))


TAGS = [(1, 0, "B-P"), (1, 1, "I-P"), (1, 2, "I-P"), (2, 0, "I-P"), (2, 1, "O"), (3, 0, "B-P"), (3, 1, "I-S"), (4, 0, "X-P"), (5, 0, "B-UNKNOWN"), (6, 0, "O"), (6, 1, "B-S"), (7, 0, "x"), (7, 1, "I-X"), (8, 0, "B-Q"), (8, 1, "I-Q")]


@query(f"""WITH t AS (SELECT *, lag(tag) OVER (PARTITION BY rec ORDER BY pos) AS b FROM (VALUES {_values(TAGS)}) AS x(rec, pos, tag)) SELECT rec, pos, tag, 'unknown_label' AS error FROM t WHERE tag NOT IN ('O', 'B-P', 'I-P', 'B-S', 'I-S')
    UNION ALL SELECT rec, pos, tag, 'invalid_bio_label' FROM t WHERE tag <> 'O' AND tag NOT LIKE 'B-%' AND tag NOT LIKE 'I-%'
    UNION ALL SELECT rec, pos, tag, 'illegal_i_without_b' FROM t WHERE tag LIKE 'I-%' AND NOT coalesce((b LIKE 'B-%' OR b LIKE 'I-%') AND substr(b, 3) = substr(tag, 3), false)""")
def bio_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bio_violations(spark.sql(f"SELECT * FROM VALUES {_values(TAGS)} AS x(rec, pos, tag)"), ["O", "B-P", "I-P", "B-S", "I-S"])


SPANS = [(1, "abcdef", 0, 3, "abc"), (1, "abcdef", 2, 5, "cde"), (2, "abc", 0, 9, "abc"), (3, "abc", 2, 2, ""), (4, "ab", 0, 2, "zz"), (5, "abc", None, 2, "ab"), (6, "abc", 0, 2, "ab"), (6, "abc", 2, 3, "c"), (7, "abc", -1, 9, "x"), (8, "abcd", 3, 1, "x"), (9, "abcdef", 0, 4, "abcd"), (9, "abcdef", 1, 3, "bc"), (9, "abcdef", 2, 5, "cde")]


@query(f"""WITH s AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY s, e) AS b FROM (VALUES {_values(SPANS)}) AS x(rec, text, s, e, value)), r AS (SELECT rec, s, e, 'span_bounds_not_int' AS error FROM s WHERE s IS NULL OR e IS NULL
    UNION ALL SELECT rec, s, e, 'span_out_of_range' FROM s WHERE s < 0 OR e > length(text) UNION ALL SELECT rec, s, e, 'span_end_not_after_start' FROM s WHERE e <= s
    UNION ALL SELECT rec, s, e, 'span_value_mismatch' FROM s WHERE s >= 0 AND s < e AND e <= length(text) AND substr(text, s + 1, e - s) <> value
    UNION ALL SELECT rec, arg_min(s, (s, e)), arg_min(e, (s, e)), 'overlapping_entities' FROM s WHERE s < b GROUP BY rec) SELECT rec, s AS "start", e AS "end", error FROM r""")
def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.span_violations(spark.sql(f"SELECT * FROM VALUES {_values(SPANS)} AS x(rec, text, start, end, value)"))


JSONS = [('{"text": "a", "tokens": null}',), ('{"label": 1}',), ('{"x": 1}',), ("{}",)]


@query(f"SELECT j, CASE WHEN list_has_any(json_keys(j), ['tokens', 'ner_tags', 'tag_names', 'typed_spans', 'entities']) THEN 'token' WHEN list_has_any(json_keys(j), ['label', 'label_name']) THEN 'sequence' ELSE 'unknown' END AS task FROM (VALUES {_values(JSONS)}) AS t(j)")
def detect_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values(JSONS)} AS t(j)").select("j", audit.detect_task(F.col("j")).alias("task"))


BAD = [(1, None, None), (2, "  ", "1"), (3, "ok", "7"), (4, "ok", "1"), (5, "ok", None)]


@query(f"SELECT seq, error, coalesce(text, '') AS preview FROM (SELECT seq, text, CASE WHEN text IS NULL THEN 'MissingText' WHEN trim(text) = '' THEN 'EmptyText' WHEN raw NOT IN ('LEAK', 'NON_LEAK', '0', '1') THEN 'InvalidSequenceLabel' END AS error FROM (VALUES {_values(BAD)}) AS t(seq, text, raw)) WHERE error IS NOT NULL")
def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT seq, text, raw AS raw_label FROM VALUES {_values(BAD)} AS t(seq, text, raw)")
    return audit.malformed(rows.withColumn("label", text.binary_label("audit", F.col("raw_label"))))


# Leakage and clean splits.


@query(f"""WITH {REC}, a AS (SELECT DISTINCT normalized_hash, file AS train_file FROM rec WHERE split = 'train' AND NOT protected), b AS (SELECT DISTINCT normalized_hash, file AS protected_file FROM rec WHERE protected)
    SELECT train_file, protected_file, normalized_hash AS hash, 'NORMALIZED_TEXT' AS overlap_type FROM a JOIN b USING (normalized_hash)""")
def protected_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.protected_overlap(_records(spark, sf_dir))


def _matrix_sql(key: str) -> str:
    return f"c AS (SELECT {key} AS h, file, count(*) AS c FROM rec GROUP BY ALL), m AS (SELECT a.file AS file_a, b.file AS file_b, CAST(sum(CASE WHEN a.file = b.file THEN a.c - 1 ELSE least(a.c, b.c) END) AS BIGINT) AS shared FROM c a JOIN c b ON a.h = b.h AND a.file <= b.file GROUP BY ALL)"


@query(f"WITH {REC}, {_matrix_sql('exact_hash')} SELECT * FROM m WHERE shared > 0")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.overlap_matrix(_records(spark, sf_dir), "exact_hash")


@query(f"WITH {GRP}, s AS (SELECT DISTINCT group_id, file FROM rec) SELECT a.file AS file_a, b.file AS file_b, count(*) AS shared_groups FROM s a JOIN s b ON a.group_id = b.group_id AND a.file < b.file GROUP BY ALL")
def group_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.group_overlap_matrix(_grouped(spark, sf_dir))


@query(f"WITH {REC}, s AS (SELECT DISTINCT normalized_hash, file FROM rec) SELECT a.file AS file_a, b.file AS file_b, count(*) AS affected FROM s a JOIN s b ON a.normalized_hash = b.normalized_hash AND a.file <> b.file GROUP BY ALL")
def affected_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.affected_unique(_records(spark, sf_dir))


def _roles(records: DataFrame) -> DataFrame:
    return records.groupBy("file").agg(F.first(leakage.role(F.col("split"), F.col("protected"))).alias("role"), F.lit(False).alias("critical"))


@query(f"""WITH {REC}, {_matrix_sql('normalized_hash')}, r AS (SELECT DISTINCT file, CASE WHEN protected THEN 'P' WHEN split = 'train' THEN 'T' ELSE 'V' END AS r FROM rec), u AS (SELECT DISTINCT normalized_hash, file FROM rec),
    f AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS affected FROM u a JOIN u b ON a.normalized_hash = b.normalized_hash AND a.file <> b.file GROUP BY ALL)
    SELECT m.file_a, m.file_b, shared AS normalized, coalesce(affected, 0) AS affected, CASE WHEN 'T' IN (a.r, b.r) AND 'P' IN (a.r, b.r) THEN 'HIGH' WHEN 'T' IN (a.r, b.r) AND 'V' IN (a.r, b.r) THEN 'MEDIUM' WHEN 'T' IN (a.r, b.r) THEN 'LOW' WHEN 'P' IN (a.r, b.r) THEN 'HIGH' ELSE 'LOW' END AS severity,
    'T' IN (a.r, b.r) AND a.r <> b.r AS blocker FROM m JOIN r a ON a.file = m.file_a JOIN r b ON b.file = m.file_b LEFT JOIN f ON f.file_a = m.file_a AND f.file_b = m.file_b WHERE shared > 0""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    return leakage.pair_summary(rec, _roles(rec)).select("file_a", "file_b", "normalized", "affected", "severity", "blocker").where("normalized > 0")


@query(f"WITH {REC}, {_matrix_sql('normalized_hash')}, r AS (SELECT DISTINCT file, CASE WHEN protected THEN 'P' WHEN split = 'train' THEN 'T' ELSE 'V' END AS r FROM rec) SELECT count(*) AS pairs, CAST(sum(shared) AS BIGINT) AS shared, count(*) FILTER ('T' IN (a.r, b.r) AND a.r <> b.r) AS blockers FROM m JOIN r a ON a.file = m.file_a JOIN r b ON b.file = m.file_b WHERE shared > 0")
def active_leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_summary(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.sum("normalized").alias("shared"), F.count_if("blocker").alias("blockers"))


OPTION_A = "oa AS (SELECT * FROM rec WHERE split = 'train' AND NOT protected AND normalized_hash NOT IN (SELECT normalized_hash FROM rec WHERE protected OR split = 'validation'))"
OPTION_B = """po AS (SELECT * FROM rec WHERE split IN ('train', 'validation') AND NOT protected AND normalized_hash NOT IN (SELECT normalized_hash FROM rec WHERE protected)),
    ob AS (SELECT seq, CASE WHEN (dense_rank() OVER (ORDER BY normalized_hash) - 1) % 5 = 0 THEN 'validation' ELSE 'train' END AS new_split FROM po)"""


@query(f"WITH {REC}, {OPTION_A} SELECT seq FROM oa")
def option_a_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.option_a(_records(spark, sf_dir)).select("seq")


@query(f"WITH {REC}, {OPTION_B} SELECT * FROM ob")
def option_b_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.option_b(_records(spark, sf_dir)).select("seq", "new_split")


@query(f"WITH {REC}, {OPTION_A}, {OPTION_B}, n AS (SELECT (SELECT count(*) FROM oa) AS a, (SELECT count(*) FROM ob WHERE new_split = 'train') AS b) SELECT a, b, CASE WHEN a >= greatest(100, b // 2) THEN 'OPTION_A' ELSE 'OPTION_B' END AS plan FROM n")
def recommended_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    kept = leakage.option_a(rec).select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(leakage.option_b(rec).where("new_split = 'train'").select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = kept.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    return counts.withColumn("plan", leakage.recommended(F.col("a"), F.col("b")))


@query(f"WITH {REC} SELECT seq FROM rec WHERE NOT protected AND normalized_hash NOT IN (SELECT normalized_hash FROM rec WHERE protected)")
def anti_join_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    return leakage.without(rec.where("NOT protected"), rec.where("protected")).select("seq")


@query(f"WITH {REC} SELECT normalized_hash, coalesce(label, '') AS label, min(seq) AS seq FROM rec GROUP BY ALL")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit("")))
    return build.keep_first(rows, ["normalized_hash", "label"]).select("normalized_hash", "label", "seq")


@query(f"""WITH {REC}, r AS (SELECT *, row_number() OVER (PARTITION BY normalized_hash, label, seq % 2 ORDER BY seq) AS k FROM rec WHERE label IS NOT NULL), t AS (SELECT * FROM r WHERE seq % 2 = 0), s AS (SELECT * FROM r WHERE seq % 2 = 1)
    SELECT t.seq AS token_seq, s.seq AS sequence_seq, CASE WHEN t.seq IS NULL THEN 'sequence' WHEN s.seq IS NULL THEN 'token' ELSE 'both' END AS task FROM t FULL JOIN s ON t.normalized_hash = s.normalized_hash AND t.label = s.label AND t.k = s.k""")
def merge_same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("label IS NOT NULL")
    return build.merge_same_text(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("token_seq", "sequence_seq", "task")


@query(f"""WITH {REC}, h AS (SELECT DISTINCT normalized_hash, split FROM rec) SELECT p.a || '-' || p.b || ':normalized_hash' AS "check", (SELECT count(*) FROM h x JOIN h y USING (normalized_hash) WHERE x.split = p.a AND y.split = p.b) AS shared
    FROM (VALUES ('train', 'validation'), ('train', 'calibration'), ('validation', 'calibration')) AS p(a, b)""")
def split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    return build.split_isolation({s: rec.where(F.col("split") == s) for s in ("train", "validation", "calibration")}).where("check LIKE '%hash'")


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)) LIMIT 50")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.deterministic_sample(_docs(spark, sf_dir), "doc_id", 50, 42).select("doc_id")


@query("""WITH l AS (SELECT doc_id, toxic = 1 AS hard, sha256('7:' || CAST(doc_id AS VARCHAR)) AS d FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY d) AS k FROM l)
    SELECT doc_id, hard FROM r ORDER BY CASE WHEN hard THEN k > 30 ELSE k > 70 END, d LIMIT 100""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.stratified_sample(_t(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1, 100, 0.3, 7).select("doc_id", "hard")


@query("WITH l AS (SELECT doc_id, toxic = 1 AS hard FROM labels) SELECT doc_id, hard, round(CASE WHEN hard THEN 0.25 ELSE 0.75 END / count(*) OVER (PARTITION BY hard), 12)::DOUBLE AS weight FROM l")
def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.sampling_weights(_t(spark, sf_dir, "labels"), F.col("toxic") == 1, 0.25).select("doc_id", "hard", F.round("weight", 12).alias("weight"))


# Evaluation.

CELLS = "count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"


def _rates_sql(source: str, keys: str) -> str:
    d = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    rec, spec = d("tp", "tp + fn"), d("tn", "tn + fp")
    cols = {"accuracy": d("tp + tn", "tn + fp + fn + tp"), "balanced_accuracy": f"CASE WHEN tp + fn = 0 THEN {spec} WHEN tn + fp = 0 THEN {rec} ELSE ({rec} + {spec}) / 2 END", "precision": d("tp", "tp + fp"), "recall": rec, "f1": d("2 * tp", "2 * tp + fp + fn"), "specificity": spec, "fpr": d("fp", "fp + tn"), "fnr": d("fn", "fn + tp")}
    mcc = "CASE WHEN tp + fn = 0 OR tn + fp = 0 OR tp + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt((tp + fp)::DOUBLE * (tp + fn)) * sqrt((tn + fp)::DOUBLE * (tn + fn))) END"
    return f"SELECT {keys}tn, fp, fn, tp, tn + fp + fn + tp AS samples, round({mcc}, 6)::DOUBLE AS mcc, " + ", ".join(f"round({e}, 6)::DOUBLE AS {n}" for n, e in cols.items()) + f" FROM {source}"


@query(f"WITH {SCO}, c AS (SELECT {CELLS} FROM pre) {_rates_sql('c', '')}")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.binary_metrics(_scored(spark, sf_dir))


@query(f"WITH {SCO}, c AS (SELECT event_type, {CELLS} FROM pre GROUP BY 1) {_rates_sql('c', 'event_type, ')}")
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.binary_metrics(_scored(spark, sf_dir), ["event_type"])


@query(f"WITH {SCO}, g AS (SELECT 1 AS g, score, count(*) AS n, sum(label) AS pos FROM sco GROUP BY ALL), w AS (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT g, round((sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)))::DOUBLE, 6) AS roc_auc FROM w GROUP BY 1")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_scored(spark, sf_dir).withColumn("g", F.lit(1)), ["g"])


@query(f"WITH {SCO}, g AS (SELECT 1 AS g, score, count(*) AS n, sum(label) AS pos FROM sco GROUP BY ALL), w AS (SELECT *, sum(pos) OVER o::DOUBLE / sum(n) OVER o AS p FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT g, round((sum(pos * p) / sum(pos))::DOUBLE, 6) AS average_precision FROM w GROUP BY 1")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_scored(spark, sf_dir).withColumn("g", F.lit(1)), ["g"])


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("int").alias("gold"), (F.col("vec_id") % 5).cast("int").alias("predicted"), (F.col("vec_id") % 50).alias("row_index"))


TOK = "tok AS (SELECT label % 4 AS gold, vec_id % 5 AS predicted, vec_id % 50 AS row_index FROM embeddings)"
PRF = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query(f"WITH {TOK}, c AS (SELECT count(*) FILTER (gold <> 0 AND gold = predicted) AS tp, count(*) FILTER (predicted <> 0 AND gold <> predicted) AS fp, count(*) FILTER (gold <> 0 AND gold <> predicted) AS fn FROM tok) SELECT *, {PRF} FROM c")
def token_micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_micro(_tokens(spark, sf_dir))


TYPES = [(0, None), (1, "PERSON"), (2, "PERSON"), (3, "CONTACT"), (4, "PLACE")]


@query(f"""WITH {TOK}, d AS (SELECT * FROM (VALUES {_values(TYPES)}) AS t(label_id, entity_type)), n AS (SELECT g.entity_type AS gt, p.entity_type AS pt FROM tok JOIN d g ON gold = g.label_id JOIN d p ON predicted = p.label_id),
    c AS (SELECT e.entity_type, count(*) FILTER (gt = e.entity_type AND pt = e.entity_type) AS tp, count(*) FILTER (pt = e.entity_type AND gt IS DISTINCT FROM pt) AS fp, count(*) FILTER (gt = e.entity_type AND gt IS DISTINCT FROM pt) AS fn FROM (SELECT DISTINCT entity_type FROM d WHERE entity_type IS NOT NULL) e, n GROUP BY 1) SELECT *, {PRF} FROM c""")
def per_type_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_type(_tokens(spark, sf_dir), spark.sql(f"SELECT * FROM VALUES {_values(TYPES)} AS t(label_id, entity_type)"))


@query(f"WITH {TOK} SELECT row_index, count(*) FILTER (gold <> predicted) AS errors FROM tok GROUP BY 1 HAVING count(*) FILTER (gold <> predicted) > 0")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_errors(_tokens(spark, sf_dir))


GRID = [0.5, 1.0, 2.0, 4.0]


@query(f"WITH {SCO}, m AS (SELECT CASE WHEN label = 1 THEN -1 ELSE 1 END * (score * 4 - 2) AS m FROM sco) SELECT t AS temperature, round(avg(ln(1 + exp(m / t))), 6) AS nll FROM m, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY 1")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _scored(spark, sf_dir).select("label", F.lit(0.0).alias("z0"), (F.col("score") * 4 - 2).alias("z1"))
    return evaluate.temperature_grid(logits, GRID)


SWEEP = f"{SCO}, th AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) AS r(i)), c AS (SELECT threshold, " + CELLS.replace("prediction = 0", "score < threshold").replace("prediction = 1", "score >= threshold") + " FROM sco, th GROUP BY 1)"


@query(f"WITH {SWEEP} {_rates_sql('c', 'threshold, ')}")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(_scored(spark, sf_dir))


@query(f"""WITH {SWEEP}, w AS ({_rates_sql('c', 'threshold, ')}), k AS (SELECT *, CASE WHEN recall >= 0.5 AND fpr <= 0.6 THEN 0 WHEN recall >= 0.5 THEN 1 ELSE 2 END AS r FROM w)
    SELECT threshold, CASE r WHEN 0 THEN 'STRICT_RECALL_AND_FPR' WHEN 1 THEN 'RECALL_ONLY_FALLBACK' ELSE 'BEST_F1_FALLBACK' END AS rule, f1, precision, recall, specificity FROM k
    ORDER BY r, f1 DESC, CASE r WHEN 0 THEN precision WHEN 1 THEN -fpr ELSE recall END DESC, CASE r WHEN 0 THEN specificity WHEN 1 THEN precision ELSE -fpr END DESC, threshold LIMIT 1""")
def choose_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.choose_threshold(evaluate.threshold_sweep(_scored(spark, sf_dir)), 0.5, 0.6)


@query("WITH m AS (SELECT 'value' AS task, event_type AS model, round(avg(value), 6) AS mean_f1 FROM events GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY task ORDER BY mean_f1 DESC) AS rank FROM m")
def model_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.lit("value").alias("task"), F.col("event_type").alias("model"), F.col("value").alias("f1"))
    return evaluate.rankings(rows).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, round(0.3 * quality + 0.3 * toxic + 0.2 * quality + 0.2 * toxic - 0.1 * toxic, 6)::DOUBLE AS score FROM labels")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return _t(spark, sf_dir, "labels").select("doc_id", F.round(evaluate.selection_score(q, t, q, t, t), 6).alias("score"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_k_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_k(_t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 20)


MERGE = [("ab cd ef gh", 0, "B-P", 0.9, 0, 2), ("ab cd ef gh", 1, "I-P", 0.7, 3, 5), ("ab cd ef gh", 2, "B-S", 0.8, 6, 8), ("ab cd ef gh", 3, "I-S", 0.3, 9, 11), ("xy zw", 0, "B-P", 0.6, 0, 2), ("xy zw", 1, "O", 0.9, 3, 5)]


@query(f"""WITH t AS (SELECT *, substr(tag, 3) AS type FROM (VALUES {_values(MERGE)}) AS x(text, pos, tag, score, s, e) WHERE tag <> 'O' AND score >= 0.55 AND e > s), r AS (SELECT *, sum(CASE WHEN coalesce(lag_type = type AND lag_pos = pos - 1 AND s <= lag_end + 1, false) THEN 0 ELSE 1 END) OVER (PARTITION BY text ORDER BY pos) AS run
    FROM (SELECT *, lag(type) OVER w AS lag_type, lag(pos) OVER w AS lag_pos, lag(e) OVER w AS lag_end FROM t WINDOW w AS (PARTITION BY text ORDER BY pos)))
    SELECT text, any_value(type) AS type, min(s) AS "start", max(e) AS "end", round(avg(score), 4)::DOUBLE AS score, substr(text, min(s) + 1, max(e) - min(s)) AS value FROM r GROUP BY text, run""")
def merge_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT text, pos, tag, CAST(score AS DOUBLE) AS score, start, end FROM VALUES {_values(MERGE)} AS x(text, pos, tag, score, start, end)")
    return evaluate.merge_spans(rows)


PIECES = [(1, 0, None, 0), (1, 1, 0, 5), (1, 2, 0, 5), (1, 3, 1, 6), (1, 4, None, 0), (2, 0, 0, 7)]


@query(f"SELECT rec, pos, CASE WHEN word_id IS NULL OR lag(word_id) OVER (PARTITION BY rec ORDER BY pos) = word_id THEN -100 ELSE label END AS aligned FROM (VALUES {_values(PIECES)}) AS t(rec, pos, word_id, label)")
def align_subtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.align_subtokens(spark.sql(f"SELECT * FROM VALUES {_values(PIECES)} AS t(rec, pos, word_id, label)")).select("rec", "pos", "aligned")


# Report.

RECTS = [(1, "regex", 10.01, 5.0, 20.0, 9.0), (1, "regex", 10.04, 5.0, 20.0, 9.0), (1, "model", 10.0, 5.0, 20.0, 9.0), (2, "regex", 10.0, 5.0, 20.0, 9.0)]


@query(f"SELECT page, kind, round_even(x0::DOUBLE, 1) AS x0, round_even(y0::DOUBLE, 1) AS y0, round_even(x1::DOUBLE, 1) AS x1, round_even(y1::DOUBLE, 1) AS y1, count(*) - 1 AS skipped FROM (VALUES {_values(RECTS)}) AS t(page, kind, x0, y0, x1, y1) GROUP BY ALL")
def dedup_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "y0", "x1", "y1"))
    return report.dedup_rects(spark.sql(f"SELECT page, kind, {cast} FROM VALUES {_values(RECTS)} AS t(page, kind, x0, y0, x1, y1)"))


FOUND = [(1, "P", "ab", "0.5", 0, 2), (2, "", "ab", "0.5", 0, 2), (3, "P", "a", "0.5", 0, 2), (4, "P", "ab", "1.5", 0, 2), (5, "P", "ab", "0.5", 2, 2), (6, "P", None, "0.5", 0, 2), (7, "P", "ab", None, 0, 2)]


@query(f"SELECT i, coalesce(trim(kind) <> '' AND length(trim(value)) >= 2 AND TRY_CAST(score AS DOUBLE) BETWEEN 0 AND 1 AND s >= 0 AND e > s, false) AS valid FROM (VALUES {_values(FOUND)}) AS t(i, kind, value, score, s, e)")
def invalid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(FOUND)} AS t(i, kind, value, score, s, e)")
    return rows.select("i", report.valid_finding(*(F.col(c) for c in ("kind", "value", "score", "s", "e"))).alias("valid"))


PAGES = [(1, 1, 1), (2, 1, 2), (3, None, 2), (4, 9, None), (5, None, None)]


@query(f"SELECT i, CASE WHEN coalesce(own, container) IS NULL THEN 'missing' WHEN container <> own THEN 'mismatch' WHEN coalesce(own, container) NOT BETWEEN 1 AND 3 THEN 'out_of_range' ELSE 'ok' END AS state FROM (VALUES {_values(PAGES)}) AS t(i, container, own)")
def page_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_values(PAGES)} AS t(i, container, own)")
    return rows.select("i", report.page_resolution(F.col("container"), F.col("own"), 3).alias("state"))


@query(f"WITH {UNIT} {FIND} SELECT DISTINCT doc_id, unit_no, type AS kind, value, CAST((length(sentence) - length(replace(sentence, value, ''))) / length(value) AS BIGINT) AS occurrences FROM hit JOIN uni USING (doc_id, unit_no)")
def value_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir).withColumn("findings", patterns.findings(F.col("sentence")))
    return report.highlights(units, ["doc_id"]).withColumn("unit_no", F.col("unit_no").cast("long"))


@query(f"""WITH {STATE_SQL}, {VALIDITY_SQL}, e AS (SELECT i, validity, unnest(['LEAK', 'NON_LEAK']) AS final_label FROM v), f AS (SELECT *, unnest([true, false]) AS named FROM e), g AS (SELECT *, unnest([true, false]) AS marked FROM f)
    SELECT i, final_label, named, marked, CASE WHEN final_label <> 'LEAK' THEN 'none' WHEN named AND validity <> 'VALID_LEAK' THEN 'warning' WHEN validity = 'VALID_LEAK' THEN CASE WHEN marked THEN 'both' ELSE 'sequence' END WHEN marked THEN 'token' ELSE 'none' END AS evidence FROM g""")
def report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    validity = decide.sequence_validity(*(F.col(c) for c in ("status", "label", "prediction", "p", "h")))
    both = lambda n: F.explode(F.array(F.lit(True), F.lit(False))).alias(n)
    rows = _states(spark).select("i", validity.alias("validity"), F.explode(F.array(F.lit("LEAK"), F.lit("NON_LEAK"))).alias("final_label")).select("*", both("named")).select("*", both("marked"))
    sources = F.when(F.col("named"), F.array(F.lit(decide.SEQUENCE))).otherwise(F.array().cast("array<string>"))
    return rows.select("i", "final_label", "named", "marked", report.evidence(F.col("final_label"), sources, F.col("validity"), F.lit(True), F.col("marked")).alias("evidence"))


# Fixtures that reach every branch, each with its SQL.


def _fixture(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t({columns})")


#: seq, file, split, protected, task, label, group, text
PLANNED = [
    (1, "t1", "train", "n", "token", "LEAK", "g1", "one"), (2, "s1", "train", "n", "sequence", "LEAK", "g1", "one"), (3, "s1", "train", "n", "sequence", "NON_LEAK", None, "one"), (4, "t1", "train", "n", "token", "NON_LEAK", "g2", "two"),
    (5, "s1", "train", "n", "sequence", "NON_LEAK", "", "two"), (6, "s2", "validation", "n", "sequence", "LEAK", "g3", "three"), (7, "t1", "train", "n", "token", "LEAK", "g3", "three"), (8, "s3", "test", "y", "sequence", "LEAK", "g4", "four"),
    (9, "t1", "train", "n", "token", "LEAK", None, "four"), (10, "s4", "old", "n", "sequence", "LEAK", "g5", "five"), (11, "t1", "train", "n", "token", "LEAK", "g5", "five"), (12, "s1", "train", "n", "sequence", "LEAK", "g4", "six"), (13, "s2", "validation", "n", "sequence", "NON_LEAK", "g6", "seven"),
    (14, "s1", "train", "n", "sequence", "NON_LEAK", "g7", "eight"), (15, "s1", "train", "n", "sequence", "LEAK", "g7", "nine"),
]
PLAN_SQL = f"""pl AS (SELECT seq, file, split, p = 'y' AS protected, task, label, grp AS group_id, sha256(text) AS normalized_hash, CASE WHEN p = 'y' THEN 'PROTECTED_EVALUATION' WHEN split = 'train' THEN 'TRAIN_CANDIDATE' WHEN split = 'validation' THEN 'VALIDATION_CANDIDATE' ELSE 'HISTORICAL_OR_SUPERSEDED' END AS role
    FROM (VALUES {_values(PLANNED)}) AS t(seq, file, split, p, task, label, grp, text))"""


def _planned(spark: SparkSession) -> DataFrame:
    rows = _fixture(spark, PLANNED, "seq, file, split, p, task, label, group_id, text").withColumn("protected", F.col("p") == "y").drop("p")
    return rows.withColumns({"normalized_hash": text.stable_hash(F.col("text")), "role": leakage.role(F.col("split"), F.col("protected"))})


@query(f"WITH {PLAN_SQL} SELECT a.seq AS seq_a, b.seq AS seq_b FROM pl a JOIN pl b ON a.normalized_hash = b.normalized_hash AND a.seq < b.seq AND a.label <> b.label")
def label_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_conflicts(_planned(spark)).select("seq_a", "seq_b")


@query(f"WITH {REC} SELECT exact_hash AS key, min(seq) AS first_seq, count(*) AS copies, count(DISTINCT label) > 1 AS conflict FROM rec GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that stand in several records, without a cap."""
    return audit.duplicate_groups(_records(spark, sf_dir), "exact_hash")


@query(f"""WITH {GRP}, o AS (SELECT group_id, split, protected, min(seq) AS seq_b FROM rec GROUP BY ALL) SELECT a.group_id, a.seq AS seq_a, a.split AS split_a, seq_b, o.split AS split_b, CASE WHEN (a.split = 'train' AND o.protected) OR (o.split = 'train' AND a.protected) THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM rec a JOIN o ON a.group_id = o.group_id AND a.split <> o.split""")
def group_leakage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a leaking group, without a cap."""
    return audit.group_leakage(_grouped(spark, sf_dir), limit=None)


@query(f"""WITH {PLAN_SQL}, t AS (SELECT normalized_hash, file, arg_min(split, seq) AS split, arg_min(role, seq) AS role, arg_min(label, seq) AS label FROM pl WHERE task = 'token' GROUP BY ALL), s AS (SELECT normalized_hash, file, arg_min(split, seq) AS split, arg_min(role, seq) AS role, arg_min(label, seq) AS label FROM pl WHERE task = 'sequence' GROUP BY ALL)
    SELECT normalized_hash, t.file AS token_file, s.file AS sequence_file, CASE WHEN t.role IN ('TRAIN_CANDIDATE', 'PROTECTED_EVALUATION') AND s.role IN ('TRAIN_CANDIDATE', 'PROTECTED_EVALUATION') AND t.role <> s.role THEN 'SPLIT_CONFLICT' WHEN t.split = s.split AND t.label = 'LEAK' AND s.label = 'LEAK' THEN 'SAFE_BOTH_TASKS'
    WHEN t.split = s.split THEN 'SAFE_SEPARATE_TASK_RECORDS' WHEN t.role IN ('TRAIN_CANDIDATE', 'VALIDATION_CANDIDATE') AND s.role IN ('TRAIN_CANDIDATE', 'VALIDATION_CANDIDATE') AND t.role <> s.role THEN 'SPLIT_CONFLICT' ELSE 'REVIEW_REQUIRED' END AS classification FROM t JOIN s USING (normalized_hash)""")
def cross_task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.cross_task_plan(_planned(spark)).drop("notes")


KEPT_SQL = """ke AS (SELECT * FROM pl WHERE split = 'train' AND NOT protected AND normalized_hash NOT IN (SELECT normalized_hash FROM pl WHERE protected OR split = 'validation') AND (coalesce(group_id, '') = '' OR group_id NOT IN (SELECT group_id FROM pl WHERE (protected OR split = 'validation') AND group_id <> ''))),
    re AS (SELECT * FROM pl WHERE split = 'train' AND seq NOT IN (SELECT seq FROM ke))"""


@query(f"""WITH {PLAN_SQL}, {KEPT_SQL} SELECT 'OPTION_A' AS strategy, count(*) AS train_records, count(*) FILTER (task = 'token') AS token_train_records, count(*) FILTER (task = 'sequence') AS sequence_train_records, count(DISTINCT coalesce(nullif(group_id, ''), normalized_hash)) AS train_groups,
    count(*) FILTER (task = 'sequence' AND label = 'LEAK') AS sequence_leaks, count(*) FILTER (task = 'sequence' AND label = 'NON_LEAK') AS sequence_non_leaks, 0::BIGINT AS token_entities, (SELECT count(*) FROM re) AS removed_records, (SELECT count(DISTINCT nullif(group_id, '')) FROM re) AS removed_groups, 0::BIGINT AS validation_records, 0::BIGINT AS validation_groups FROM ke""")
def projection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark)
    kept = leakage.option_a(rows)
    return leakage.projection_counters("OPTION_A", kept, rows.where("split = 'train'").join(kept.select("seq"), "seq", "left_anti"))


@query(f"""WITH {PLAN_SQL}, {KEPT_SQL}, x AS (SELECT 'kept' AS part, seq, normalized_hash, group_id FROM ke UNION ALL SELECT 'all', seq, normalized_hash, group_id FROM pl WHERE split = 'train'), o AS (SELECT * FROM pl WHERE protected OR split = 'validation')
    SELECT part, n AS "overlaps", n = 0 AS safe FROM (SELECT part, count(DISTINCT seq) FILTER (normalized_hash IN (SELECT normalized_hash FROM o) OR (coalesce(group_id, '') <> '' AND group_id IN (SELECT group_id FROM o WHERE group_id <> ''))) AS n FROM x GROUP BY 1)""")
def still_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark)
    others = rows.where("protected OR split = 'validation'")
    of = lambda d, n: leakage.still_overlaps(d, others).withColumn("part", F.lit(n))
    return of(leakage.option_a(rows), "kept").unionByName(of(rows.where("split = 'train'"), "all"))


@query(f"""WITH {PLAN_SQL}, x(a, b) AS (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) SELECT a || '-' || b || ':normalized_hash' AS "check", (SELECT count(DISTINCT p.normalized_hash) FROM pl p JOIN pl q USING (normalized_hash) WHERE p.split = a AND q.split = b) AS shared FROM x
    UNION ALL SELECT a || '-' || b || ':group_id', (SELECT count(DISTINCT p.group_id) FROM pl p JOIN pl q USING (group_id) WHERE p.split = a AND q.split = b) FROM x""")
def split_isolation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark)
    return build.split_isolation({s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")})


@query(f"""WITH {PLAN_SQL}, {_matrix_sql('normalized_hash').replace('rec GROUP', 'pl GROUP')}, g AS (SELECT DISTINCT group_id, file FROM pl WHERE group_id <> ''), gm AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM g a JOIN g b ON a.group_id = b.group_id AND a.file < b.file GROUP BY ALL),
    ro AS (SELECT DISTINCT file, role FROM pl), j AS (SELECT coalesce(m.file_a, gm.file_a) AS file_a, coalesce(m.file_b, gm.file_b) AS file_b, coalesce(shared, 0) AS shared, coalesce(n, 0) AS n FROM (SELECT * FROM m WHERE shared > 0) m FULL JOIN gm ON m.file_a = gm.file_a AND m.file_b = gm.file_b)
    SELECT count(*) AS historical_pairs, coalesce(CAST(sum(shared) AS BIGINT), 0) AS historical_exact, coalesce(CAST(sum(shared) AS BIGINT), 0) AS historical_normalized, coalesce(CAST(sum(n) AS BIGINT), 0) AS historical_shared_groups FROM j JOIN ro x ON x.file = file_a JOIN ro y ON y.file = file_b WHERE 'HISTORICAL_OR_SUPERSEDED' IN (x.role, y.role)""")
def historical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark).withColumn("exact_hash", F.col("normalized_hash"))
    return leakage.historical_summary(leakage.pair_summary(rows, _roles(rows)))


@query(f"""WITH {REC}, u AS (SELECT DISTINCT normalized_hash, file FROM rec), n AS (SELECT file, count(*) AS n FROM u GROUP BY 1), f AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS affected FROM u a JOIN u b ON a.normalized_hash = b.normalized_hash AND a.file < b.file GROUP BY ALL)
    SELECT file_a, file_b, round(100.0 * affected / x.n, 4)::DOUBLE AS percentage_a, round(100.0 * affected / y.n, 4)::DOUBLE AS percentage_b FROM f JOIN n x ON x.file = file_a JOIN n y ON y.file = file_b""")
def affected_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    return leakage.pair_summary(rec, _roles(rec)).where("file_a <> file_b AND affected > 0").select("file_a", "file_b", "percentage_a", "percentage_b")


CAUSES = [(i, *(int(x) for x in f"{i:05b}")) for i in range(32)]


@query(f"""SELECT i, CASE WHEN h = 1 THEN 'HISTORICAL_VERSION_OVERLAP' WHEN s = 1 THEN 'SAME_FILE_DUPLICATES' WHEN g = 1 AND n = 0 THEN 'SAME_GROUP_SPLIT' WHEN g = 1 THEN 'SAME_TEMPLATE_FAMILY' WHEN e = 1 THEN 'EXACT_TEXT_COPY' WHEN n = 1 THEN 'NORMALIZATION_ONLY' ELSE 'UNKNOWN' END AS cause FROM (VALUES {_values(CAUSES)}) AS t(i, s, h, e, n, g)""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, CAUSES, "i, s, h, e, n, g")
    return rows.select("i", leakage.root_cause(F.col("s") == 1, F.col("h") == 1, F.col("e"), F.col("n"), F.col("g")).alias("cause"))


IDS = [(1, "[0,1,2]", None), (2, "[3,9,-1]", None), (3, "[0]", "B-X"), (4, None, None)]


@query("SELECT * FROM (VALUES (1, 'O,B-P,I-P'), (2, 'B-S,UNKNOWN_ID_9,UNKNOWN_ID_-1'), (3, 'B-X'), (4, '')) AS t(i, labels)")
def token_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, IDS, "i, ids, name").select("i", F.from_json("ids", "array<int>").alias("ids"), F.when(F.col("name").isNotNull(), F.array("name")).alias("names"))
    known = F.array(*map(F.lit, ("O", "B-P", "I-P", "B-S")))
    return rows.select("i", F.array_join(audit.token_labels(F.col("names"), F.col("ids"), known), ",").alias("labels"))


GROUPS = [(1, " g1 ", "p", "c"), (2, "", "p", "c"), (3, None, " ", "c"), (4, "true", None, "c"), (5, None, None, None)]


@query(f"""WITH t AS (SELECT i, CASE WHEN lower(g) NOT IN ('true', 'false') THEN nullif(trim(g), '') END AS g, nullif(trim(p), '') AS p, nullif(trim(c), '') AS c FROM (VALUES {_values(GROUPS)}) AS t(i, g, p, c)) SELECT i, coalesce(g, p, c) AS build, coalesce(g, p) AS audit, g AS evaluate FROM t""")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, GROUPS, "i, group_id, pair_id, case_id")
    return rows.select("i", *(text.group_key(v, rows.columns).alias(v) for v in text.GROUP_FIELDS))


FLAGS = [(1, "false"), (2, "False"), (3, "true"), (4, None), (5, "0")]


@query(f"SELECT i, coalesce(lower(f) = 'false', false) AS hard, i % 3 = 0 OR i = 5 AS updates, CAST(ceil(i / 3.0) AS BIGINT) AS count FROM (VALUES {_values(FLAGS)}) AS t(i, f)")
def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, FLAGS, "i, f")
    return rows.select("i", build.is_hard(F.col("f")).alias("hard"), build.updates_here(F.col("i"), F.lit(5), 3).alias("updates"), build.optimizer_updates(F.col("i"), 3).alias("count"))


@query(f"""WITH {REC}, v AS (SELECT DISTINCT file, coalesce(label, 'MISSING') AS v FROM rec), p AS (SELECT file, arg_min(normalized_text, seq) AS t FROM rec WHERE normalized_text <> '' GROUP BY 1)
    SELECT file, count(*) AS records, (SELECT count(*) FROM v WHERE v.file = rec.file) AS label_values, (SELECT CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END FROM p WHERE p.file = rec.file) AS sample_text_preview, 0::BIGINT AS malformed_count FROM rec GROUP BY file""")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dataset_info(_records(spark, sf_dir)).select("file", "records", F.size("label_counts").cast("long").alias("label_values"), "sample_text_preview", "malformed_count")


RULES = [(0.5, 0.6), (0.999, 0.0), (1.5, 0.0)]


def _rule_sql(recall: float, fpr: float) -> str:
    return f"""(SELECT {recall}::DOUBLE AS target, threshold, rule, f1 FROM (SELECT *, CASE r WHEN 0 THEN 'STRICT_RECALL_AND_FPR' WHEN 1 THEN 'RECALL_ONLY_FALLBACK' ELSE 'BEST_F1_FALLBACK' END AS rule FROM (SELECT *, CASE WHEN recall >= {recall} AND fpr <= {fpr} THEN 0 WHEN recall >= {recall} THEN 1 ELSE 2 END AS r FROM w))
        ORDER BY r, f1 DESC, CASE r WHEN 0 THEN precision WHEN 1 THEN -fpr ELSE recall END DESC, CASE r WHEN 0 THEN specificity WHEN 1 THEN precision ELSE -fpr END DESC, threshold LIMIT 1)"""


@query(f"WITH {SWEEP}, w AS ({_rates_sql('c', 'threshold, ')}) " + " UNION ALL ".join(_rule_sql(*r) for r in RULES))
def choose_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each kind: all targets met, recall alone, neither."""
    sweep, out = evaluate.threshold_sweep(_scored(spark, sf_dir)), None
    for recall, fpr in RULES:
        row = evaluate.choose_threshold(sweep, recall, fpr).select(F.lit(recall).alias("target"), "threshold", "rule", "f1")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT doc_id, round(0.5 * quality + 0.5 * toxic, 6)::DOUBLE AS score FROM labels")
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").select("doc_id", F.round(evaluate.mean_score(F.col("quality").cast("double"), F.col("toxic").cast("double")), 6).alias("score"))


@query(f"""WITH {REC} SELECT 'train_sequence_' || lpad(CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR), 7, '0') AS id, normalized_hash, CASE label WHEN 'LEAK' THEN 1 WHEN 'NON_LEAK' THEN 0 END AS sequence_label, category, 'documents' AS source_dataset FROM rec""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).drop("normalized_hash")
    return build.canonical_records(rows, "sequence", "train", "documents").select("id", "normalized_hash", "sequence_label", "category", "source_dataset")
