"""Shards of stable keys by jump consistent hashing (Lamping and Veach, 2014), on built-in expressions.

A key's shard follows from the key and the number of shards alone: there is no
ring table, and one more shard takes rows only into itself, 1/(n+1) of them.

Defined cases: a null key hashes like -1; rows that repeat a key share its
shard and take neighbouring slots, in the order of their other columns; an empty
table gives no rows. Text is only measured, so its length does not matter.
Other columns of the input are never looked at by ``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import free_name
from deckspark.operators.ordered import global_row_number

#: Multiplier of the generator in the published algorithm, as two 32-bit halves. Fixed value.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_MASK = 0xFFFFFFFF
#: Jumps that the first loop allows. The expected number is ln(shards) + 0.58; keys that need more
#: (about one in 10^12 at a million shards) take the second loop, which allows every number.
SHORT_LOOP = 48


def _low_product(factor: int, word: Column) -> Column:
    """factor * word mod 2^32 for 32-bit values, in 16-bit pieces so that nothing overflows."""
    low = word.bitwiseAND(0xFFFF) * factor
    high = (F.shiftright(word, 16) * factor).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(_MASK)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 mod 2^64 over two 32-bit halves."""
    first = lo.bitwiseAND(0xFFFF) * _LOW
    second = F.shiftright(lo, 16) * _LOW
    low = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(second, 16) + _low_product(_LOW, hi) + _low_product(_HIGH, lo)
    return high.bitwiseAND(_MASK), low.bitwiseAND(_MASK)


def _jumps(state: Column, shards: int, most: int) -> Column:
    """Jump while the next bucket is below ``shards``, at most ``most`` times."""

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        # The published loop divides 2^31 by the generator's top 31 bits plus one.
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1)))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("bucket"), ahead.alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, jump)


def jump_state(key: Column, shards: int) -> Column:
    """The end of the loop: ``bucket`` is the shard, ``next`` the first bucket at or beyond ``shards``."""
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_MASK).alias("lo"),
        F.lit(-1).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("next"),
    )
    # A jump goes at least one bucket ahead, so ``shards`` jumps are always enough.
    state = _jumps(start, shards, min(SHORT_LOOP, shards))
    return state if shards <= SHORT_LOOP else F.when(
        state["next"] >= shards, state
    ).otherwise(_jumps(start, shards, shards))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of an integer key, from 0."""
    return jump_state(key, shards)["bucket"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Adds the shard of each row and, if asked, its shard once there is one more.

    Integer keys are used as they are, others by their 64-bit hash. No shuffle.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kind = dict(df.dtypes)[key]
    number = F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    jump = free_name(df, "_jump")
    out = df.withColumn(jump, jump_state(number, shards))
    out = out.withColumn(shard, F.col(jump)["bucket"].cast("int"))
    if grown:
        # With one more shard the loop stops in the new one only if it was the next bucket.
        moved = F.when(F.col(jump)["next"] == shards, F.lit(shards)).otherwise(F.col(jump)["bucket"])
        out = out.withColumn(grown, moved.cast("int"))
    return out.drop(jump)


def shard_slots(df: DataFrame, order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard gapless from 0, in the given order.

    A window per shard would put a whole shard in one task. Rows are ranged by (shard,
    order, position) instead, so that a shard, and even one key that repeats without
    end, spreads over partitions; each partition's numbers start after those before.
    Hand over narrow rows: they are checkpointed twice.
    """
    at = free_name(df, "_at")
    rows = df.withColumn(at, F.monotonically_increasing_id()).checkpoint()
    numbered = global_row_number(rows, [*order, at], (shard,), slot)
    return numbered.withColumn(slot, F.col(slot) - 1).drop(at)
