"""Page text to lines, line kinds, blocks and units.

Everything about a page is said by expressions over the array of its lines, so nothing is shuffled, a page is one row
until its units are exploded, and keys need not be unique or known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.text import let, normalize_document, strip

# Fixed values.
CLOSERS = "\"')\\]}\\u05F4\\u05F3"
SENTENCE_END = rf"[.!?؟…][{CLOSERS}]*$"
LIST_ITEM = r"(?U)^(?:[••●▪▫◦‣⁃]\s+|(?:\d+|[A-Za-z]|[א-ת])\s*[.)]\s+)"
ONLY_MARKS = r"(?U)^[\W_]+$"
# What a line keeps whole, in order.
PROTECTED = [
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:https?|ftp)://[^\s]+",
    r"\bwww\.[^\s]+",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"\b\d{1,4}[/.]\d{1,2}[/.]\d{1,4}\b",
    r"\b\d+(?:[.,]\d+)+\b",
    r"\b(?:[A-Za-z0-9_-]+\.)+[A-Za-z]{2,}\b",
    r"\b[A-Za-z]:\\(?:[^\\\s]+\\)*[^\\\s]*",
]
MARK = "￰"


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def ends_sentence(line: Column) -> Column:
    return line.rlike(SENTENCE_END)


def only_marks(line: Column) -> Column:
    return line.rlike(ONLY_MARKS)


def masked(line: Column) -> Column:
    """Addresses, times, dates, numbers, domains and paths as one placeholder each."""
    for p in PROTECTED:
        line = F.regexp_replace(line, f"(?iU){p}", MARK)
    return line


def _hidden(k: int) -> str:
    """The placeholder of a pattern."""
    return MARK + chr(0xE000 + k)


def protect(line: Column) -> Column:
    """A struct of the line with a placeholder for each match, pattern after pattern, and the matches of each pattern."""
    state = F.struct(line.alias("text"), F.array().cast("array<array<string>>").alias("values"))
    for k, p in enumerate(PROTECTED):
        state = let(state, _hide(k, f"(?iU){p}"))
    return state


def _hide(k: int, pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.regexp_replace(s["text"], pattern, _hidden(k)).alias("text"), F.concat(s["values"], F.array(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)))).alias("values"))


def _show(own: Column) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.concat(x, F.coalesce(F.get(own, i), F.lit("")))


def restore(text: Column, values: Column) -> Column:
    """A protected line, or any pieces of it in order, with its matches again: the last pattern's first, since its
    matches may hold placeholders of those before."""
    for k in reversed(range(len(PROTECTED))):
        text = F.array_join(F.transform(F.split(text, _hidden(k), -1), _show(F.get(values, F.lit(k)))), "")
    return text


def is_label_value(line: Column) -> Column:
    """`label: value`: a colon with text on both sides, the left of which neither ends a sentence nor holds ; ? or !."""
    fits = masked(line).rlike(rf"(?U)^[^;?!؟]+(?<![.…][{CLOSERS}]{{0,20}}\s{{0,20}})[:：]\s*\S")
    return F.when(line.contains(":") | line.contains("："), fits).otherwise(F.lit(False))


def _middle(sizes: Column) -> Column:
    return (F.get(sizes, F.floor((F.size(sizes) - 1) / 2).cast("int")) + F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))) / F.lit(2.0)


def _lines(text: Column, stripped: bool) -> Column:
    raw = F.split(text, "\n", -1)
    return raw if stripped else F.transform(raw, strip)


def _filled(lines: Column) -> Column:
    """The lines that aren't blank, with their number and predicates."""
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda r: r["line"] != "")

    def judged(r: Column) -> Column:
        x = r["line"]
        return F.struct(r["line_no"].alias("line_no"), x.alias("line"), F.length(x).alias("size"), is_label_value(x).alias("is_label"), is_list_item(x).alias("is_list"), ends_sentence(x).alias("ends_sentence"), only_marks(x).alias("only_marks"))

    return F.transform(numbered, judged)


def _sized(rows: Column, body: Callable[[Column], Column]) -> Column:
    """body of a struct of the page's median length and its lower half's."""
    sizes = F.array_sort(F.transform(rows, lambda r: r["size"]))
    half = lambda s: F.slice(s, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(s) / 2).cast("int")))
    both = let(sizes, lambda s: F.struct(F.coalesce(_middle(s), F.lit(0.0)).alias("median_length"), F.coalesce(_middle(half(s)), F.lit(0.0)).alias("lower_length")))
    return let(both, body)


def _placed(rows: Column, lower: Column) -> Column:
    """rows with their neighbours and kind: metadata, list_item, heading or body."""

    def place(r: Column, k: Column) -> Column:
        before, after = F.get(rows, k - 1), F.get(rows, k + 1)
        previous_blank = before.isNull() | (before["line_no"] < r["line_no"] - 1)
        next_blank = after.isNull() | (after["line_no"] > r["line_no"] + 1)
        short = (lower <= 0) | (r["size"] <= lower)
        followed = (after["size"] > r["size"]) | after["is_label"] | after["is_list"]
        heading = ~r["ends_sentence"] & ~r["only_marks"] & short & (previous_blank | next_blank | F.coalesce(followed, F.lit(False)) | (before.isNull() & after.isNotNull()))
        kind = F.when(r["is_label"], "metadata").when(r["is_list"], "list_item").when(heading, "heading").otherwise("body")
        named = {c: r[c] for c in ("line_no", "line", "is_label", "is_list", "ends_sentence", "only_marks")}
        extra = {"previous_line": before["line"], "next_line": after["line"], "previous_blank": previous_blank, "next_blank": next_blank, "kind": kind}
        return F.struct(*(c.alias(n) for n, c in (named | extra).items()))

    return F.transform(rows, place)


def line_records(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 0), line (stripped), and the page's median length and lower half's median length."""
    lines = pages.select(*keys, F.explode(F.array(_lines(F.col(text), False))).alias("_lines"))
    sized = F.explode(F.array(let(_filled(F.col("_lines")), lambda rows: _sized(rows, lambda s: s))))
    return lines.select(*keys, "_lines", sized.alias("_s")).select(*keys, "_s.*", F.posexplode("_lines").alias("line_no", "line"))


def line_features(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every line, blank ones too: keys, line_no, line, lengths, the nearest lines that aren't blank, predicates and kind."""
    pages = pages.select(*keys, F.explode(F.array(_lines(F.col(text), False))).alias("_lines"))

    def all_lines(placed: Column) -> Column:
        """Each line that isn't blank with the blank ones behind it; a row before the first has those that lead."""
        no_line = F.transform(F.slice(placed, 1, 0), lambda r: r)
        size = F.size("_lines")

        def blanks(first: Column, end: Column, before: Column, after: Column) -> Column:
            row = lambda i: F.struct(
                i.alias("line_no"), F.lit("").alias("line"), *(F.lit(False).alias(c) for c in ("is_label", "is_list", "ends_sentence", "only_marks")),
                before.alias("previous_line"), after.alias("next_line"), ((i > first) | before.isNull()).alias("previous_blank"), ((i < end - 1) | after.isNull()).alias("next_blank"), F.lit("blank").alias("kind"),
            )
            return F.when(end > first, F.transform(F.sequence(first, F.greatest(first, end - 1)), row)).otherwise(no_line)

        nothing = F.lit(None).cast("string")
        lead = blanks(F.lit(0), F.coalesce(F.get(placed, F.lit(0))["line_no"], size), nothing, F.get(placed, F.lit(0))["line"])
        rest = F.transform(placed, lambda r, k: F.concat(F.array(r), blanks(r["line_no"] + 1, F.coalesce(F.get(placed, k + 1)["line_no"], size), r["line"], r["next_line"])))
        return F.concat(lead, F.flatten(rest))

    found = let(_filled(F.col("_lines")), lambda rows: _sized(rows, lambda s: F.struct(s["median_length"].alias("median_length"), s["lower_length"].alias("lower_length"), let(_placed(rows, s["lower_length"]), all_lines).alias("lines"))))
    return pages.select(*keys, F.explode(F.array(found)).alias("_p")).select(*keys, "_p.median_length", "_p.lower_length", F.inline("_p.lines"))


def join_wrapped(lines: Column) -> Column:
    """Lines of a paragraph as one: a hyphen at a line's end joins without a blank."""
    last = F.size(lines) - 1
    pieces = F.transform(lines, lambda x, i: F.when(i == last, x).when(x.endswith("-") | x.endswith("־"), F.regexp_replace(x, "[-־]+$", "")).otherwise(F.concat(x, F.lit(" "))))
    return F.when(F.size(lines) == 1, _collapsed(F.get(lines, F.lit(0)))).otherwise(_collapsed(F.array_join(pieces, "")))


def _collapsed(text: Column) -> Column:
    """White space as single blanks, none at the ends; most texts are so already."""
    return F.when(text.rlike(r"(?U)^\s|\s\s|\s$|[\s&&[^ ]]"), strip(F.regexp_replace(text, r"(?U)\s+", " "))).otherwise(text)


def _blocks(placed: Column) -> Column:
    """Islands of body lines up to a sentence's end, all other lines alone."""

    def opens(k: Column) -> Column:
        r, before = F.get(placed, k), F.get(placed, k - 1)
        return (k == 0) | (r["kind"] != "body") | r["previous_blank"] | (before["kind"] != "body") | before["ends_sentence"]

    every = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), opens)
    starts = F.when(F.size(placed) > 0, every).otherwise(F.array().cast("array<int>"))
    texts = F.transform(placed, lambda r: r["line"])

    def cut(s: Column, lines: Column) -> Column:
        return F.transform(s, lambda first, j: join_wrapped(F.slice(lines, first + 1, F.coalesce(F.get(s, j + 1), F.size(lines)) - first)))

    return F.filter(let(starts, lambda s: let(texts, lambda lines: cut(s, lines))), lambda x: x != "")


def _page_blocks(text: Column, stripped: bool) -> Column:
    return let(_filled(_lines(text, stripped)), lambda rows: _sized(rows, lambda s: let(_placed(rows, s["lower_length"]), _blocks)))


def blocks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, block_no (from 0), block."""
    return pages.select(*keys, F.posexplode(_page_blocks(F.col(text), False)).alias("block_no", "block"))


def _sentences(text: Column) -> Column:
    """Pieces after sentence ends. The end of an address or path is no sentence end, so a mark is set behind it."""
    shielded = F.regexp_replace(text, r"(?iU)(\b(?:(?:https?|ftp)://|www\.)[^\s]+|\b[a-z]:\\[^\s]*)(?=\s)", f"$1{MARK}")
    address = text.contains("/") | text.contains("\\") | text.rlike(r"(?iU)www\.")
    pieces = F.split(F.when(address, shielded).otherwise(text), r"(?U)(?<=[.!?؟…])\s+(?=\S)", -1)
    return F.transform(pieces, lambda p: F.when(p.contains(MARK), F.replace(p, F.lit(MARK), F.lit(""))).otherwise(p))


def split_sentences(text: Column) -> Column:
    """The sentences of any text, white space collapsed; pieces of marks alone are left out."""
    return F.filter(F.transform(_sentences(text), _collapsed), lambda p: (p != "") & ~only_marks(p))


def _units(block: Column) -> Column:
    whole = is_label_value(block) | is_list_item(block) | ~ends_sentence(block)
    return F.when(whole, F.array(block)).otherwise(split_sentences(block))


def text_units(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The whole chain from raw page text: keys, unit_no (from 0), sentence."""
    # Normalised lines have no white space at their ends.
    found = F.flatten(F.transform(_page_blocks(normalize_document(F.col(text)), True), _units))
    return pages.select(*keys, F.posexplode(F.filter(found, lambda x: x != "")).alias("unit_no", "sentence"))


def token_chunks(text: Column, limit: int, special: int = 2) -> Column:
    """Blank-separated tokens in chunks of at most limit - special."""
    step = max(1, limit - special)
    tokens = F.split(search_collapsed(text), " ")
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(step)), " "))


def search_collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))
