"""Word splitting shared by the text operators, in Spark and inside tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Text split at ASCII white space, and at everything in ASCII but digits and letters.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_IS_WORD = set(b"0123456789" + LOWER.encode()) | set(range(128, 256))
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_TABLE = bytes(b if b in _IS_WORD else 32 for b in _FOLDED)
_LETTER_TABLE = bytes(32 if 48 <= b <= 57 else b for b in _WORD_TABLE)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str) -> Column:
    """The non-empty parts of a text between separators; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    return F.filter(parts, lambda part: part != "")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Whole rows as one column ``row``, beside the columns an operator needs.

    Whatever names the columns of ``docs`` have, none can clash with its own.
    """
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that went into :func:`packed`."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_WORD_TABLE).split() if text else []


def letters_only(text: str) -> bytes:
    """Lower-case letters and non-ASCII characters between single spaces."""
    return b" %b " % b" ".join(text.lower().encode().translate(_LETTER_TABLE).split())
