"""What a run's report text says, as columns: its lines, its end, and a signature that equal failures share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space within a line, and around it.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a report's end that results keep.
EXCERPT = 2000


def lines(text: Column) -> Column:
    """The lines that are not blank; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """The last characters of a text."""
    return F.substring(F.coalesce(text, F.lit("")), -most, most)


def folded(text: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(text, UPPER, LOWER)


def marked(of_lines: Column, markers: tuple[str, ...]) -> Column:
    """How many lines hold one of the markers, which are lower-case words, in any case of letters."""
    hit = lambda x: F.array_contains(F.transform(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(folded(x), m)), True)
    return F.size(F.filter(of_lines, hit)).cast("long")


def signature(of_lines: Column) -> Column:
    """Sixteen hex digits that reports share whose last lines differ in digits, case and outer white space alone."""
    last = F.coalesce(F.try_element_at(of_lines, F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(last, rf"^{BLANK}+|{BLANK}+$", "")
    return F.substring(F.sha2(F.regexp_replace(folded(bare), "[0-9]+", "#"), 256), 1, 16)
