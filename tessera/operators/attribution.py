"""Named sources in a text: names followed by a number, and keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: What introduces a saying's source.
KEYWORDS = ("رواه", "أخرجه", "متفق عليه", "البخاري", "مسلم", "الترمذي", "النسائي", "ابن ماجه", "أبو داود", "أحمد", "إلخ")
MAX_NAMES = 10_000
NEXT_WORDS = 5


def name_dictionary(names: Column, rows: DataFrame, spec: tx.NormSpec = tx.ARABIC, least: int = 3) -> DataFrame:
    """Distinct normalised names of ``least`` characters or more."""
    return rows.select(tx.norm(names, spec).alias("name")).where(F.length("name") >= least).distinct()


def alternatives(names: list[str]) -> str:
    """A regex of the names, longer ones first, so that the longest wins at a place."""
    if len(names) > MAX_NAMES:
        raise ValueError(f"{len(names)} names are too many for one pattern")
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", n) for n in sorted(set(names), key=lambda n: (-len(n), n)))


def named(text: Column, names: list[str], spec: tx.NormSpec = tx.ARABIC_DIGITS) -> Column:
    """How many names have a digit within the five words after them; a name's place is used once."""
    if not names:
        return F.when(text.isNotNull(), F.lit(0))
    ahead = rf"(?=(\s*(?:\S+\s+){{0,{NEXT_WORDS - 1}}}\S*[0-9٠-٩])?)"
    found = F.regexp_extract_all(tx.norm(text, spec), F.lit(f"(?:{alternatives(names)}){ahead}"), F.lit(1))
    return F.size(F.filter(found, lambda x: x != ""))


def keywords(text: Column, words: tuple[str, ...] | list[str], spec: tx.NormSpec = tx.ARABIC_DIGITS) -> Column:
    """Places of the keywords, inside longer words too, without overlaps. The words are normalised
    already; ``arabic_keywords`` gives the fixed list so."""
    return F.regexp_count(tx.norm(text, spec), F.lit(alternatives(list(words))))


def arabic_keywords() -> list[str]:
    """The fixed list with its letters folded as in normalised text."""
    fold = str.maketrans(*tx.ARABIC_FOLD)
    return sorted({" ".join(k.translate(fold).split()) for k in KEYWORDS})
