"""Row-level expressions; all are plain Columns, so they stay inside whole-stage codegen."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names, class weights, gain per hit and cost per contact.
STAYS = "CONTINUA"
LEAVES_NEXT = "BAJA+1"
LEAVES_SECOND = "BAJA+2"
CLASS_WEIGHTS = {"BAJA+1": 1.00001, "BAJA+2": 1.00002}
GAIN_HIT = 273000
COST_CONTACT = 7000

SPLIT_BITS = 31
SPLIT_PRIME = (1 << SPLIT_BITS) - 1


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_sum(*cols: str | Column) -> Column:
    """Sum that counts a null as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den; null when the denominator is null or zero, zero when only num is null."""
    return F.coalesce(_col(num), F.lit(0)) / F.nullif(_col(den), F.lit(0))


def variation(now: str | Column, before: str | Column) -> Column:
    """Relative change against an earlier value; null when that value is null or zero."""
    return F.try_divide(_col(now).cast("double"), _col(before).cast("double")) - 1


def tenure_scaled(counter: str | Column, tenure: str | Column) -> Column:
    """Bring a quarterly counter of a new customer to a whole quarter."""
    c, t = _col(counter).cast("double"), _col(tenure)
    return F.when(t == 1, c * 3).when(t == 2, c * 3 / 2).otherwise(c)


def class_weight(label: str | Column) -> Column:
    """Weight that tells the classes apart; customers who stay or have no label weigh 1."""
    c = _col(label)
    w = F.lit(1.0)
    for name, weight in CLASS_WEIGHTS.items():
        w = F.when(c == name, F.lit(weight)).otherwise(w)
    return w


def binary_targets(label: str | Column) -> tuple[Column, Column]:
    """(leaves in the second month, does not stay); a missing label counts as not staying."""
    c = _col(label)
    second = c.eqNullSafe(LEAVES_SECOND).cast("int")
    not_staying = (~c.eqNullSafe(STAYS)).cast("int")
    return second, not_staying


def row_gain(hit: Column, gain: int = GAIN_HIT, cost: int = COST_CONTACT) -> Column:
    """Profit of contacting one customer."""
    return F.when(hit, F.lit(gain)).otherwise(F.lit(-cost)).cast("long")


def yyyymm(ts: str | Column) -> Column:
    return (F.year(_col(ts)) * 100 + F.month(_col(ts))).cast("int")


def month_index(period: str | Column) -> Column:
    """Months since year 0 of a yyyymm number: differences are calendar months."""
    p = _col(period).cast("int")
    return (F.floor(p / 100) * 12 + p % 100 - 1).cast("int")


def split_numbers(split: int, seed: int) -> tuple[int, int]:
    """Multiplier and offset of a split: from an md5 hash, so that no split follows from others."""
    digest = hashlib.md5(f"split-{split}-{seed}".encode()).hexdigest()
    return int(digest[:13], 16) % (SPLIT_PRIME - 1) + 1, int(digest[13:26], 16) % SPLIT_PRIME


def split_key(key: Column, a: Column, b: Column) -> Column:
    """A new uniform 31-bit key for every split, from one sample number: a * key + b modulo a prime.

    The two numbers of a split order the rows anew without hashing every row again.
    """
    return (key % SPLIT_PRIME * a + b) % SPLIT_PRIME


def sample_key(id_col: str | Column, seed: int | Column) -> Column:
    """The sampling order: an md5 hash of the id and the seed, as hex digits.

    Never null, so joins on its digits do not hash every row again to test for nulls.
    """
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(_col(id_col).cast("string"), F.lit("-"), seed_text))
    return F.coalesce(digest, F.lit(""))


def sample_number(id_col: str | Column, seed: int | Column) -> Column:
    """The same hash as a number of 52 uniform bits: its first 13 digits."""
    return F.conv(F.substring(sample_key(id_col, seed), 1, 13), 16, 10).cast("long")
