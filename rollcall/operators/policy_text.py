"""Plain wording for technical terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.tables import TERMS


def title(word: str) -> str:
    return word.title()


def translate_terms(text: Column, terms: dict[str, str] = TERMS) -> Column:
    """Replace each term, then its capitalised form, in table order."""
    for technical, plain in terms.items():
        text = F.replace(F.replace(text, F.lit(technical), F.lit(plain)), F.lit(title(technical)), F.lit(title(plain)))
    return text
