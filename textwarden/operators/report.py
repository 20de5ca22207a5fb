"""Report evidence and rectangle geometry of marked pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.text import search_text
from textwarden.operators.decide import SEQUENCE, finite


def share_line(a: Column, b: Column, tolerance: Column) -> Column:
    """Whether two rectangles stand on one line: both edges close, or most of the lower one's height in common."""
    close = (F.abs(a["y0"] - b["y0"]) <= tolerance) & (F.abs(a["y1"] - b["y1"]) <= tolerance)
    common = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return close | ((common > 0) & (common >= F.lit(0.7) * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])))


def merge_lines(rects: DataFrame) -> DataFrame:
    """The rectangles of each marked sentence (item), merged greedily by line; a sentence's rectangles are few.

    A fold over the sorted rectangles: each widens the first line that it shares, or begins one.
    """
    sides = ("x0", "y0", "x1", "y1")
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    corners = lambda r: F.struct(*(r[c].alias(c) for c in sides))
    heights = F.array_sort(F.transform("_r", lambda r: r["y1"] - r["y0"]))
    tolerance = F.greatest(F.lit(1.0), F.lit(0.25) * F.get(heights, F.floor(F.size("_r") / 2).cast("int")))

    def widen(line: Column, r: Column) -> Column:
        return F.struct(F.least(line["x0"], r["x0"]).alias("x0"), F.least(line["y0"], r["y0"]).alias("y0"), F.greatest(line["x1"], r["x1"]).alias("x1"), F.greatest(line["y1"], r["y1"]).alias("y1"))

    def place(lines: Column, r: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: share_line(x, r, F.col("_t"))), F.lit(True))
        return F.when(at == 0, F.concat(lines, F.array(corners(r)))).otherwise(F.transform(lines, lambda x, i: F.when(i + 1 == at, widen(x, r)).otherwise(x)))

    sorted_ = rects.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1"))).alias("_r"))
    return sorted_.withColumn("_t", tolerance).select("item", F.inline(F.aggregate("_r", none, place)))


def dedup_rects(rects: DataFrame) -> DataFrame:
    """One rectangle per page, kind and corners rounded to a tenth, with the number that was dropped."""
    corners = [F.bround(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rects.select("page", "kind", *corners).groupBy("page", "kind", "x0", "y0", "x1", "y1").agg((F.count(F.lit(1)) - 1).alias("skipped"))


def valid_finding(kind: Column, value: Column, score: Column, start: Column, end: Column) -> Column:
    return F.coalesce((F.trim(kind) != "") & (F.length(F.trim(value)) >= 2) & finite(score).between(0, 1) & (start >= 0) & (end > start), F.lit(False))


def evidence(final_label: Column, sources: Column, validity: Column, used: Column, has_tokens: Column) -> Column:
    """token, sequence, both, warning (the sources name a sequence result that isn't valid) or none."""
    named = F.array_contains(sources, SEQUENCE)
    conflict = named & validity.isin("INVALID_RESULT", "VALID_NON_LEAK", "ERROR", "NOT_RUN")
    sequence = (named & ~conflict) | ((validity == "VALID_LEAK") & used)
    return F.when(final_label != "LEAK", "none").when(conflict, "warning").when(sequence & has_tokens, "both").when(sequence, "sequence").when(has_tokens, "token").otherwise("none")


def page_resolution(container: Column, own: Column, pages: int) -> Column:
    """ok, mismatch, out_of_range or missing from the two page fields (null: not a positive integer)."""
    page = F.coalesce(own, container)
    return F.when(page.isNull(), "missing").when(container.isNotNull() & own.isNotNull() & (container != own), "mismatch").when(~page.between(1, pages), "out_of_range").otherwise("ok")


def occurrences(text: Column, value: Column) -> Column:
    """Non-overlapping occurrences of a value."""
    return F.when(F.length(value) > 0, ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("long")).otherwise(F.lit(0).cast("long"))


def report_summary(sentences: DataFrame, pages: int, examples: int = 20) -> DataFrame:
    """One row of counters over result sentences (container_page and sentence_page as found, item as the results have
    it): leaks, evidence of each kind, findings that can't be marked, pages that don't fit, and a few examples of those."""
    leak = F.coalesce(F.col("item.decision.final_label") == "LEAK", F.lit(False))
    tokens, regex = F.col("item.token_analysis.results"), F.col("item.regex_results")
    fits = lambda t: valid_token(t["type"], t["value"], t["score"], t["start"], t["end"])
    usable = F.col("item.token_analysis.status") == "OK"
    good = F.filter(regex, lambda f: F.length(search_text(f["value"])) >= 2)
    has_tokens = F.coalesce(usable & F.exists(tokens, fits), F.lit(False))
    support = F.col("item.decision.sequence_support")
    kind = evidence(F.col("item.decision.final_label"), F.col("item.decision.evidence_sources"), support["validity"], support["used_for_final_label"], has_tokens)
    state = page_resolution(F.col("container_page"), F.col("sentence_page"), pages)
    rows = sentences.select(
        leak.alias("leak"), kind.alias("kind"), state.alias("state"), F.size(good).alias("good"), (F.size(regex) - F.size(good)).alias("bad"), has_tokens.alias("has_tokens"),
        F.when(usable, F.size(F.filter(tokens, lambda t: ~fits(t)))).otherwise(0).alias("bad_tokens"), F.coalesce("sentence_page", "container_page").alias("page"), support["validity"].alias("validity"),
    )
    leaks = F.col("leak")
    count = lambda c, name: F.count_if(leaks & c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.when(leaks, F.col(c))), F.lit(0)).alias(name)
    some = lambda value, when: F.slice(F.array_sort(F.collect_list(F.when(leaks & when, value))), 1, examples)
    wrong = F.col("state") != "ok"
    return rows.agg(
        F.count_if(leaks).alias("leak_sentences"), total("good", "regex_findings"), count(F.col("has_tokens"), "token_sentences"), count(F.col("kind").isin("sequence", "both"), "sequence_sentences"),
        count(F.col("kind").isin("sequence", "both", "token"), "sentence_markings"), total("bad", "invalid_regex_findings"), total("bad_tokens", "invalid_token_findings"), count(wrong, "invalid_pages"),
        some(F.struct("page", F.col("state").alias("reason")), wrong).alias("not_found_examples"), some(F.concat(F.lit("sequence evidence is named but its result is "), "validity"), F.col("kind") == "warning").alias("warnings"),
    )


def valid_token(kind: Column, value: Column, score: Column, start: Column, end: Column) -> Column:
    """Whether a marked span is complete: a type, a value, a score from 0 to 1 and places in order."""
    return F.coalesce((F.trim(kind) != "") & (F.trim(value) != "") & score.between(0, 1) & (start >= 0) & (end > start), F.lit(False))


def highlights(units: DataFrame, keys: list[str]) -> DataFrame:
    """What a marked page would show: the values found in each unit and how often they occur there."""
    found = units.select(*keys, "unit_no", "sentence", F.explode("findings").alias("f"))
    return found.select(*keys, "unit_no", F.col("f.type").alias("kind"), F.col("f.value").alias("value"), occurrences(F.col("sentence"), F.col("f.value")).alias("occurrences")).distinct()


def number_rects(rects: DataFrame) -> DataFrame:
    """A running number per page in reading order."""
    return rects.withColumn("number", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0")))
