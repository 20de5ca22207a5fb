"""Structured-pattern detectors with code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.functions.text import let

# Detector names and patterns, in the order of their findings.
PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b05\d{8}\b"),
    ("ID", r"(?<!\d)\d{9}(?!\d)"),
    ("MONEY", r'(?<!\d)\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:ש["״]?ח|שח)(?!\w)'),
    ("TICKET", r"\b(?:REQ|INC|SR|HR|FIN)-\d{6}\b"),
    ("PASSWORD", r"(?<!\S)[A-Za-z]+\d{4,}!(?!\S)|\b[A-Za-z]+\d{4,}!"),
    ("TECHNICAL_SECRET_KEYWORD", r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|refresh[_-]?token|private[_-]?key)\b"),
    ("CONNECTION_STRING_KEYWORD", r"(?i)\b(?:connection\s*string|database\s*url|db[_-]?url|jdbc:|mongodb://|postgres://|mysql://)\b"),
    ("ACCOUNT", r"(?<!\d)\d{8,10}(?!\d)"),
]
#: Values that these detectors found aren't accounts.
PROTECTING = ["PHONE", "ID"]
FINDING = "array<struct<type:string,value:string,start:int,end:int,source:string>>"


#: What a text must hold for a pattern to match at all, where that is cheaper to see: a substring or a simpler pattern.
NEEDS = {
    "EMAIL": "@", "PHONE": "05", "ID": r"\d{9}", "MONEY": "ח", "TICKET": "-", "PASSWORD": "!", "TECHNICAL_SECRET_KEYWORD": "(?i)key|token", "CONNECTION_STRING_KEYWORD": "(?i)connection|database|db|:",
    "ACCOUNT": r"\d{8}",
}


def _may_match(text: Column, kind: str) -> Column:
    need = NEEDS.get(kind)
    if need is None:
        return F.lit(True)
    return text.contains(need) if need.isalnum() or len(need) == 1 else text.rlike(f"(?U){need}")


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Findings of one pattern. Offsets come from the lengths of matches and of what stands between them, so they count
    code points whatever the text holds; the text is scanned twice, in the JVM, if it may match at all."""
    pattern = f"(?U){pattern}"

    def found(both: Column) -> Column:
        values, gaps = both["values"], both["gaps"]

        def at(i: Column) -> Column:
            before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x))
            return F.aggregate(F.slice(values, 1, i), before, lambda n, x: n + F.length(x))

        def finding(v: Column, i: Column) -> Column:
            return let(at(i), lambda start: F.struct(F.lit(kind).alias("type"), v.alias("value"), start.alias("start"), (start + F.length(v)).alias("end"), F.lit("regex").alias("source")))

        return F.transform(values, finding)

    scanned = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), found)
    return F.when(_may_match(text, kind) & text.rlike(pattern), scanned).otherwise(F.array().cast(FINDING))


def findings(text: Column) -> Column:
    """All findings in detector order; none for null or blank texts."""

    def with_accounts(first: Column) -> Column:
        kind, pattern = PATTERNS[-1]
        protected = F.transform(F.filter(first, lambda f: f["type"].isin(PROTECTING)), lambda f: f["value"])
        return F.concat(first, F.filter(matches(text, pattern, kind), lambda f: ~F.array_contains(protected, f["value"])))

    every = let(F.concat(*(matches(text, p, k) for k, p in PATTERNS[:-1])), with_accounts)
    return F.when(text.rlike(r"(?U)\S"), every).otherwise(F.array().cast(FINDING))
