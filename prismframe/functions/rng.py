"""Random draws as pure expressions: the same in every engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of row seeds and the step between the seeds of embedded crops.
SEED_MODULUS = 2147483647
EMBED_STEP = 7919


def uniform(salt: str | Column, key: str | Column) -> Column:
    """A draw in [0, 1) for a salt and a key: the first 32 bits of their md5."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws("|", salt, key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def between(low: float, high: float, u: Column) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def chosen(p: float, salt: str | Column, key: str | Column) -> Column:
    """True with probability p."""
    return uniform(salt, key) < F.lit(float(p))


def normal(salt: str, key: str | Column) -> Column:
    """A standard normal draw (Box and Muller)."""
    u, v = uniform(salt + "/a", key), uniform(salt + "/b", key)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)


def batch_seed(seed: int, batch_rows: Column, counter: Column) -> Column:
    """The seed of a batch: the length it really has counts, so a last, shorter one differs."""
    return F.pmod(F.lit(seed).cast("long") + batch_rows.cast("long") * counter.cast("long"), F.lit(SEED_MODULUS))


def row_seed(batch: Column, slot: Column) -> Column:
    return F.pmod(batch + slot, F.lit(SEED_MODULUS))
