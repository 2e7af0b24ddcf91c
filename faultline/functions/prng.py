"""Portable pseudo-random columns: integer arithmetic that every SQL engine does alike."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODULUS, FACTOR, STEP = 2147483648, 1103515245, 12345


def draw(key: Column, seed: int | Column = 42) -> Column:
    """Integer from 0 to 2^31 - 1 for each key; two rounds, so near keys differ in all bits but the low ones."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    once = ((key.cast("long") % MODULUS) * FACTOR + STEP + seed) % MODULUS
    return (once * FACTOR + STEP) % MODULUS


def uniform(key: Column, seed: int | Column = 42) -> Column:
    """Double in [0, 1)."""
    return draw(key, seed) / F.lit(float(MODULUS))


def below(key: Column, n: Column, seed: int | Column = 42) -> Column:
    """Integer from 0 to n - 1 from the high bits (the low ones have short periods)."""
    return F.floor(draw(key, seed) / F.lit(65536.0)).cast("long") % n


def name_key(name: Column) -> Column:
    """Integer from 0 to 2^28 - 1 for a name of any type."""
    return F.conv(F.substring(F.md5(name.cast("string")), 1, 7), 16, 10).cast("long")


def sql_name_key(name: str) -> str:
    return f"CAST('0x' || substring(md5(CAST({name} AS VARCHAR)), 1, 7) AS BIGINT)"


def trial_seed(trial: Column) -> Column:
    return trial * 7 + 13


def draws(keys, seed: int = 42):
    """The same integers of a numpy array; remainders keep the key's sign, as in SQL."""
    from numpy import fmod

    once = fmod(fmod(keys, MODULUS) * FACTOR + STEP + seed, MODULUS)
    return fmod(once * FACTOR + STEP, MODULUS)


def sql_draw(key: str, seed: int | str = 42) -> str:
    """The same integer as SQL text."""
    return f"(((({key}) % {MODULUS}) * {FACTOR} + {STEP} + ({seed})) % {MODULUS} * {FACTOR} + {STEP}) % {MODULUS}"
