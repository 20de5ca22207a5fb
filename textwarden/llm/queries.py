"""The queries op1 to op10: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textwarden.llm import byte_bpe, decontaminate, exact_dedup, langid, near_dedup, ppm, secrets, token_store, toxicity, warc
from textwarden.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "question_overlap", "answer_overlap")


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_ppm_score": op3_ppm_score,
    "op4_token_ids": op4_token_ids,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}

#: Words as the operator cuts them: lower case, ended by blanks and ASCII marks.
WORDS_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

#: The 20 bytes of a SHA-1 in base 32: four bits for each hexadecimal digit, five for each letter.
BITS_SQL = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '')"
BASE32_SQL = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(b, CAST(5 * i + k + 1 AS BIGINT), 1) AS INT) * (16 >> CAST(k AS INT)))) AS BIGINT) + 1, 1)), '')"

SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id WHERE r.c < e.v),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_warc": f"""
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS h, {BITS_SQL} AS b FROM pages), f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY 1)
        SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d JOIN f USING (h)""",
    "op2_decontaminate": f"""
        WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
        c AS (SELECT item_id, w, greatest(5, CAST(ceil(len(w) / 4.0) AS BIGINT)) AS a FROM b WHERE len(w) >= 10),
        p AS (SELECT item_id, 1 AS part, list_slice(w, 1, len(w) - a) AS w FROM c UNION ALL SELECT item_id, 2, list_slice(w, len(w) - a + 1, len(w)) FROM c),
        s AS (SELECT DISTINCT item_id, part, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT item_id, part, w, unnest(range(1, len(w) - 3)) AS i FROM p)),
        n AS (SELECT item_id, part, count(*) AS n FROM s GROUP BY ALL),
        d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        e AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        m AS (SELECT doc_id, item_id, part, count(*) AS k FROM e JOIN s USING (g) GROUP BY ALL),
        r AS (SELECT doc_id, item_id, max(k / n) FILTER (part = 1) AS question_overlap, max(k / n) FILTER (part = 2) AS answer_overlap FROM m JOIN n USING (item_id, part) GROUP BY ALL)
        SELECT doc_id, item_id, question_overlap, answer_overlap FROM r WHERE question_overlap >= 0.8 AND answer_overlap >= 0.8""",
    "op5_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
}
