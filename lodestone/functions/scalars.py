"""Scalar functions on columns: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prime of the linear hashes.
PRIME = 1000000007


def linear_hashes(n: int, modulus: int) -> list[tuple[int, int]]:
    """Fixed (a, b) of ``((a x + b) mod PRIME) mod modulus``; a below 2^20, so that x below 2^31 fits 64 bits."""
    return [((48271 * (j + 1) + 12345 * j * j) % 1048573 + 1, (69621 * (j + 7)) % modulus) for j in range(n)]


def hashed(x: Column, hashes: list[tuple[int, int]], modulus: int) -> Column:
    """An array of all hashes of x."""
    return F.array(*(F.pmod(F.pmod(x * F.lit(a) + F.lit(b), F.lit(PRIME)), F.lit(modulus)) for a, b in hashes))


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of the binary form; of zero itself one (F16)."""
    binary = F.bin(x)
    return F.when(x == 0, 1).otherwise(F.length(binary) - F.length(F.rtrim(binary, F.lit("0"))))


def guarded_ratio(x: Column, y: Column, otherwise: float = 0.0) -> Column:
    """x / y, or ``otherwise`` where y is 0."""
    return F.when(y != 0, x / y).otherwise(F.lit(otherwise))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-x))


def step(x: Column) -> Column:
    """1 where x is at least 0, or else 0."""
    return F.when(x >= 0, 1.0).otherwise(0.0)


def text_number(x: Column) -> Column:
    """The first eight hexadecimal digits of a text's digest as a number: equal in any engine."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def absent(x: Column, word: str = "None") -> Column:
    """Null where a text is the word for a missing value (P10)."""
    return F.nullif(x, F.lit(word))


def short_year(day: Column) -> Column:
    """A text date ``m/d/yyyy`` with a year of two digits; day and month keep their padding."""
    return F.regexp_replace(day, r"/[0-9]*([0-9]{2})$", "/$1")
