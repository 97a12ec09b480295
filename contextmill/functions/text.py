"""Column expressions over text. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A piece ends after its separator, so the pieces of a text join back to it. Runs of other characters are taken
# possessively, which gives the same pieces as ``.+?`` up to the separator without trying that at every character.
PARAGRAPH = r"(?s).(?:[^\n]++|\n(?!\n))*+(?:\n\n++|\z)"
LINE = r"(?s).[^\n]*+(?:\n++|\z)"
SENTENCE = r"(?s).(?:[^.!?\n]++|[.!?](?![.!?]*+[ \n\t\r]))*+(?:[.!?]++[ \n\t\r]++|\n++|\z)"
WORD = r"(?s).[^ \n\t\r]*+(?:[ \n\t\r]++|\z)"
WHITESPACE_TOKEN = r"[^ \n\t\r]+"
SPACED_TOKEN = r"[^ \n\t\r]+[ \n\t\r]*"
WORD_TOKEN = r"[\p{L}\p{N}]+"
BEYOND_LATIN = r"[^\x00-\xff]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentences(text: Column) -> Column:
    """Ordered sentences; a terminator with whitespace, or a line break, ends one."""
    return split_pieces(text, SENTENCE)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return split_pieces(F.lower(text), WORD_TOKEN)


def word_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WHITESPACE_TOKEN))


def preview(text: Column, length: int) -> Column:
    """The first characters of a text on one line."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def word_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that occur in the text."""
    words = word_set(question)
    found = F.size(F.array_intersect(words, word_tokens(text)))
    return F.try_divide(found.cast("double"), F.size(words).cast("double"))
