"""Text expressions, Column to Column. Offsets are code points from 0, half open. A null text gives
null unless a function says otherwise."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(low: int, high: int) -> str:
    return "".join(map(chr, range(low, high + 1)))


@dataclass(frozen=True)
class NormSpec:
    """``drop``: characters deleted; ``fold``: (from, to) of the same length; ``keep``: regex class of
    what isn't turned into a space; ``lower``: lower-cased first."""

    drop: str = ""
    fold: tuple[str, str] = ("", "")
    keep: str = r"\p{L}"
    lower: bool = False


#: Marks that are deleted, letters that are folded, letters that stay.
ARABIC_MARKS = _span(0x0610, 0x061A) + _span(0x064B, 0x065F) + "ٰـ" + _span(0x06D6, 0x06ED)
ARABIC_FOLD = ("أإآٱىةؤئ", "اااايهوي")
ARABIC_LETTERS = r"ء-غف-ي"
ARABIC = NormSpec(ARABIC_MARKS, ARABIC_FOLD, ARABIC_LETTERS)
ARABIC_DIGITS = NormSpec(ARABIC_MARKS, ARABIC_FOLD, ARABIC_LETTERS + r"0-9٠-٩")
LATIN = NormSpec(keep=r"\p{L}", lower=True)
#: Fixed value: the diacritics that the review tool's search ignores.
REVIEW_MARKS = r"ً-ٰۖ-ۜ۟-۪ۤۧۨ-ۭ"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row: an expression inside a lambda, or used
    several times, would else be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(text: Column, spec: NormSpec = ARABIC) -> Column:
    """Marks deleted, letter variants folded, all else but kept characters one space, trimmed."""
    text = F.lower(text) if spec.lower else text
    if spec.drop or spec.fold[0]:
        text = F.translate(text, spec.fold[0] + spec.drop, spec.fold[1])
    return F.trim(F.regexp_replace(text, rf"[^{spec.keep}]+", " "))


def strip(text: Column) -> Column:
    """Without white space, of any alphabet, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(normed: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normed, " "), lambda w: w != "")


def grams(words: Column, k: int = 4) -> Column:
    """The k-word windows in order, repeats included."""
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    return let(words, lambda w: F.when(F.size(w) >= k, each(w)).otherwise(F.array().cast("array<string>")))


def py_slice(text: Column, start: Column, stop: Column) -> Column:
    """text[start:stop] with negative and overlong bounds as in Python."""
    size = F.length(text)
    bound = lambda x: F.when(x < 0, F.greatest(size + x, F.lit(0))).otherwise(F.least(x, size))
    return F.substring(text, (bound(start) + 1).cast("int"), F.greatest(bound(stop) - bound(start), F.lit(0)).cast("int"))


def occurrences(text: Column, needle: Column) -> Column:
    """All starts, overlapping ones too; none for an empty needle. Cuts the text before each place
    with one zero-width pattern and sums the lengths, so a text is read once, not once a place."""
    pattern = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(piece))).alias("starts"))
    later = let(F.split(text, pattern, -1), lambda x: F.aggregate(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), zero, step)["starts"])
    first = F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNull() | needle.isNull() | (needle == "") | (F.instr(text, needle) == 0), F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(first, later)))


def nearest(places: Column, hint: Column) -> Column:
    """The place nearest to the hint, the lower of two; the first without a hint; null if none."""
    by = lambda all_: F.transform(all_, lambda p: F.struct(F.abs(p - hint).alias("far"), p.alias("at")))
    return let(places, lambda all_: F.when(F.size(all_) > 0, F.when(hint.isNull(), F.get(all_, F.lit(0))).otherwise(F.array_min(by(all_))["at"])))


def strip_think(text: Column) -> Column:
    """Without closed reasoning blocks, stripped; an open one stays."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def strict_json(text: Column) -> Column:
    """The text if it is one JSON value and nothing else, else null: an envelope around it must keep
    its two keys."""
    envelope = F.concat(F.lit('{"v":'), text, F.lit(',"zz_end":1}'))
    keys = F.json_object_keys(envelope)
    valid = F.try_parse_json(envelope).isNotNull() & (keys == F.array(F.lit("v"), F.lit("zz_end")))
    return F.when(valid, text)


def find_json(reply: Column) -> Column:
    """The JSON text in a model's reply: without code fences as a whole, else from the first brace to
    the last; null if neither parses."""
    bare = strip(F.regexp_replace(reply, r"```(?:json)?\s*", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(reply.isNull() | (reply == ""), F.lit(None)).otherwise(F.coalesce(strict_json(bare), F.when(inner != "", strict_json(inner))))


def snippet(head: Column, tail: Column) -> Column:
    """head .... tail, or the one that is there or that both are."""
    head, tail = F.coalesce(head, F.lit("")), F.coalesce(tail, F.lit(""))
    return F.when((head != "") & (tail != "") & (head != tail), F.concat(head, F.lit(" .... "), tail)).otherwise(F.when(head != "", head).otherwise(tail))


def binary_label(token: Column) -> Column:
    """1, 0, or -1 for anything else."""
    return F.when(token == "1", 1).when(token == "0", 0).otherwise(-1)


def zero_filled(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def render_html(text: Column) -> Column:
    """Escaped, with **bold** as strong."""
    return F.regexp_replace(html_escape(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def highlighted(shown: Column, query: str | None) -> Column:
    """HTML with every place of ``query``, whatever its case, marked; unchanged for an empty query."""
    if not query:
        return shown
    return F.regexp_replace(shown, "(?iu)(" + re.escape(query) + ")", "<mark>$1</mark>")


def without_marks(text: Column) -> Column:
    """Without the diacritics that the review tool ignores (no letter is folded)."""
    return F.regexp_replace(text, f"[{REVIEW_MARKS}]", "")


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def keep_tail(words: Column, n: int) -> Column:
    """The last n words."""
    return let(words, lambda w: F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, n))


def stripped_search(text: Column, query: Column) -> Column:
    """(start, stop) of the first place of ``query``: exact, else with diacritics ignored on both
    sides. A place found so starts right after the letter before it and takes trailing marks."""
    exact = F.instr(text, query)
    plain, wanted = without_marks(text), without_marks(query)
    chars = F.split(text, "")
    letters = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("i"), F.rlike(c, F.lit(f"[{REVIEW_MARKS}]")).alias("mark"))), lambda x: ~x["mark"])
    at = F.instr(plain, wanted) - 1
    start = F.when(at > 0, F.get(letters, at - 1)["i"] + 1).otherwise(0)
    stop = F.coalesce(F.get(letters, at + F.length(wanted))["i"], F.length(text))
    place = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))
    return F.when((query == "") | query.isNull(), F.lit(None)).when(exact > 0, place(exact - 1, exact - 1 + F.length(query))).when((wanted != "") & (at >= 0), place(start, stop))
