"""Words, shingles and row keys as Spark columns, for operators without any Python in their tasks.

Words are those of `words.py`: runs of letters, digits and marks of the text in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}\p{M}]+"


def text_of(column: str) -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    """Two numbers that tell rows apart, never null. Rows with equal id and text share them."""
    number = F.col(id_column).cast("long")
    return (F.coalesce(number, F.lit(0)),
            F.xxhash64(number.isNull(), text_of(text_column)))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of all runs of `width` words; empty if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _runs(hashes, width, lambda all_, i: F.xxhash64(
        *[F.get(all_, i + j) for j in range(width)]))


def shingle_texts(words: Column, width: int) -> Column:
    """All runs of `width` words, joined by a blank."""
    return _runs(words, width, lambda all_, i: F.array_join(F.slice(all_, i + 1, width), " "))


def _runs(items: Column, width: int, run) -> Column:
    # the list is computed once, as an array of one, and then bound to a name
    return F.flatten(F.transform(F.array(items), lambda all_: F.when(
        F.size(all_) >= width,
        F.transform(F.sequence(F.lit(0), F.size(all_) - width), lambda i: run(all_, i)),
    ).otherwise(F.slice(F.transform(all_, lambda x: run(F.array(x), F.lit(0))), 1, 0))))
