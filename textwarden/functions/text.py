"""Text normalisation as Column functions (no Python on the main path but NFC for texts that need it)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that are mapped, then those that are deleted.
MAPPED_FROM = "״“”’׳–—"
MAPPED_TO = "\"\"\"''--"
DELETED = "‏‎﻿‪‫‬"
HEBREW = "א-ת"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Python's str.strip(): all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _apart(v: Column) -> Column:
    """A blank between Hebrew letters and digits or Latin letters."""
    for left, right in ((f"[{HEBREW}]", r"(?U)\d"), (r"(?U)\d", f"[{HEBREW}]"), (f"[{HEBREW}]", "[A-Za-z]"), ("[A-Za-z]", f"[{HEBREW}]")):
        v = F.regexp_replace(v, f"({left})({right})", "$1 $2")
    return v


def normalize_document(c: Column) -> Column:
    """Extraction artefacts out, lines and paragraphs kept. Null becomes empty."""
    v = F.coalesce(c, F.lit(""))
    v = let(v, lambda x: F.when(x.contains("\r"), F.regexp_replace(x, "\r\n?", "\n")).otherwise(x))
    v = F.translate(v, "\u00a0" + MAPPED_FROM + DELETED, " " + MAPPED_TO)
    v = F.regexp_replace(v, r"[ \t]{2,}|\t", " ")
    v = F.regexp_replace(v, r"(?Udm)^[^\S\n]+|[^\S\n]+$", "")
    v = let(v, lambda x: F.when(x.rlike(f"[{HEBREW}]"), _apart(x)).otherwise(x))
    v = let(v, lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x))
    v = F.regexp_replace(v, r"(?U)\s+([,;.!?؟])", "$1")
    return strip(v)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """NFC. Texts without a character from U+0300 on are in NFC already; Python only sees the others."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), c)), c)


def normalize_key(c: Column, composed: bool = True) -> Column:
    """The key of dataset comparisons: NFC, white space collapsed to one blank, stripped."""
    v = F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(nfc(v) if composed else v, r"(?U)\s+", " "))


def stable_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def preview(c: Column, limit: int = 120) -> Column:
    v = normalize_key(c)
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("..."))).otherwise(v)


def search_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def search_variants(c: Column) -> Column:
    """Ordered distinct search terms: as it is, collapsed, line feeds as blanks."""
    v = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.filter(F.array(strip(v), search_text(v), strip(F.replace(v, F.lit("\n"), F.lit(" ")))), lambda x: x != ""))


def safe_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def bio_prefix(c: Column) -> Column:
    return F.regexp_extract(c, "^([BI])-(.*)$", 1)


def bio_type(c: Column) -> Column:
    return F.regexp_extract(c, "^([BI])-(.*)$", 2)


def type_after_dash(c: Column) -> Column:
    """The evaluation's variant: what follows the first dash, with any prefix."""
    return F.when(c.contains("-"), F.regexp_extract(c, "^[^-]*-(.*)$", 1)).otherwise(c)


# What each of the three label readers accepts.
LABELS = {
    "audit": (["LEAK", "1"], ["NON_LEAK", "0"]),
    "build": (["LEAK", "1"], ["NON_LEAK", "NON-LEAK", "0"]),
    "evaluate": (["LEAK", "SENSITIVE", "1", "1.0"], ["NON_LEAK", "NON-LEAK", "SAFE", "0", "0.0"]),
}


def binary_label(variant: str, *fields: Column) -> Column:
    """LEAK, NON_LEAK or null from the first field that one of the variant's values fits."""
    leak, safe = LABELS[variant]
    found = []
    for f in fields:
        v = F.upper(F.trim(f.cast("string")))
        found.append(F.when(v.isin(leak), "LEAK").when(v.isin(safe), "NON_LEAK"))
    return F.coalesce(*found)


def valid_group(*fields: Column) -> Column:
    """The first group field that isn't blank; null otherwise, so that missing groups never join."""
    return F.coalesce(*(F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields))


#: The fields that name a record's group, by what reads it.
GROUP_FIELDS = {"build": ["group_id", "pair_id", "case_id"], "audit": ["group_id", "pair_id"], "evaluate": ["group_id"]}


def group_key(variant: str, columns: list[str]) -> Column:
    """A record's group as one of the variants reads it, from those of its fields that are among columns; truth values
    are no groups."""
    fields = [F.when(~F.lower(F.col(c).cast("string")).isin("true", "false"), F.col(c).cast("string")) for c in GROUP_FIELDS[variant] if c in columns]
    return valid_group(*fields) if fields else F.lit(None).cast("string")
