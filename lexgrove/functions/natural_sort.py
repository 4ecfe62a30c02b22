"""Keys whose plain order is the natural order of names with numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits to which a number is padded, and the separators that a key leaves out.
DIGITS = 12
PARTS = r"(\p{Nd}+|\p{L}+|[^\- _/])"


def natural_key(name: Column | str) -> Column:
    """Numbers and words of a name, each with its kind: ``0:000000000100`` or ``1:ga``, joined by ``|``.

    Longer numbers are kept whole; any other character is a part of its own; a null name has an
    empty key.
    """
    text = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(PARTS), 1)
    number = lambda t: F.concat(F.lit("0:"), F.lpad(t, F.greatest(F.lit(DIGITS), F.length(t)), F.lit("0")))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^\p{Nd}"), number(t)).otherwise(F.concat(F.lit("1:"), F.lower(t)))), "|")
