"""Whitespace and letter-case normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"


def strip(x: Column) -> Column:
    """Remove any leading and trailing whitespace (``trim`` removes blanks only)."""
    return F.btrim(x, F.lit(WHITESPACE))


def title_case(x: Column) -> Column:
    """Capitalise every run of cased letters, wherever it starts: ``o'neil-2b`` -> ``O'Neil-2B``.

    ``initcap`` alone starts words at blanks only. Letters without case end a run, as digits do.
    """
    runs = F.regexp_extract_all(x, F.lit(f"({_CASED}+|[^{_CASED[1:]}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
