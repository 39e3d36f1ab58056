"""Column expressions on whole texts that several operators share; no Python runs on the executors.

Each step is a column of its own: an expression that a lambda refers to would be evaluated anew for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of characters other than SPACES; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(plain, " "), "")


def joined_hashes(a: str, b: str, shift: int) -> Column:
    """At each place the hash of a there and of b `shift` places on; the last `shift` places mean nothing."""
    return F.zip_with(F.col(a), F.slice(F.col(b), F.lit(1 + shift), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def with_window_hashes(df: DataFrame, hashes: str, sizes: list[int]) -> DataFrame:
    """Columns w<size>: the hash of each window of so many elements of the hash column, by its first place.

    Windows are put together from windows of powers of two, so each size takes a few passes and no slices.
    """
    df = df.withColumn("w1", F.col(hashes))
    made, top = 1, max(sizes)
    while made * 2 <= top:
        df = df.withColumn(f"w{made * 2}", joined_hashes(f"w{made}", f"w{made}", made))
        made *= 2
    for size in sizes:
        if size & (size - 1):
            have = 1 << size.bit_length() - 1
            name = f"w{have}"
            while have < size:
                part = 1 << (size - have).bit_length() - 1
                df = df.withColumn(f"w{have + part}", joined_hashes(name, f"w{part}", have))
                have += part
                name = f"w{have}"
    for size in sizes:
        df = df.withColumn(f"w{size}", F.slice(F.col(f"w{size}"), F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0))))
    kept = {f"w{s}" for s in sizes}
    return df.drop(*(c for c in df.columns if c[0] == "w" and c[1:].isdigit() and c not in kept))
