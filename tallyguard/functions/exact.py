"""Sums of doubles as exact sums of the decimal numbers they print as.

A double prints as digits and an exponent.  Numbers are summed as whole units, one accumulator per
range of ``DIGITS`` decimal places, so a sum depends neither on the order of rows nor on how they are
partitioned, and tiny and huge amounts keep all of their digits next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal places that one accumulator covers.
DIGITS = 9
_LIMB = 10**DIGITS
_WIDE = "decimal(38,0)"


def _units(column: str) -> str:
    """SQL for (range, whole units in it) of a finite DOUBLE.

    At most 17 digits and a shift below ``DIGITS`` fit 28 digits, which leaves room for 10**10 rows
    in one accumulator.
    """
    return f"""transform(array(cast({column} as string)), t -> struct(
        replace(substring_index(t, 'E', 1), '.', '') as digits,
        if(contains(t, 'E'), cast(substring_index(t, 'E', -1) as int), 0)
          - length(substring_index(substring_index(t, 'E', 1), '.', -1)) as power))[0]"""


def _text_of_limbs(sums: str, sign: str) -> str:
    """SQL for (carry, text of the limbs) of the accumulators ``sums``, sorted by range."""
    limbs = f"""aggregate(
        sequence({sums}[0].range, {sums}[size({sums}) - 1].range + 3),
        struct(cast(0 as {_WIDE}) as carry, '' as text),
        (acc, r) -> transform(array(
            cast(acc.carry + {sign} coalesce(get(filter({sums}, s -> s.range = r), 0).units, cast(0 as {_WIDE})) as {_WIDE})
          ), t -> struct(
            cast(floor((t - pmod(t, cast({_LIMB} as {_WIDE}))) / {_LIMB}BD) as {_WIDE}) as carry,
            concat(lpad(cast(cast(pmod(t, cast({_LIMB} as {_WIDE})) as bigint) as string), {DIGITS}, '0'), acc.text) as text
          ))[0])"""
    return limbs


def exact_sums(df: DataFrame, keys: list[str], amount: str, total: str, count: str | None = None) -> DataFrame:
    """Per key, the exact sum of a DOUBLE column, rounded once to DOUBLE; NULL without any amount.

    With ``count`` the rows are counted, those without an amount included.  Infinite values and NaN
    are not allowed.
    """
    parts = df.select(*keys, F.expr(f"if({amount} is null, null, {_units(amount)})").alias("_parts")).selectExpr(
        *[f"`{k}`" for k in keys],
        f"cast(floor(_parts.power / {DIGITS}) as int) as _range",
        f"cast(concat(_parts.digits, repeat('0', cast(pmod(_parts.power, {DIGITS}) as int))) as decimal(28,0)) as _value",
    )
    per_range = parts.groupBy(*keys, "_range").agg(F.sum("_value").cast(_WIDE).alias("_sum"), F.count("*").alias("_rows"))
    entry = F.when(F.col("_range").isNotNull(), F.struct(F.col("_range").alias("range"), F.col("_sum").alias("units")))
    # As many entries as ranges: 70 at most.
    grouped = per_range.groupBy(*keys).agg(
        F.array_sort(F.collect_list(entry)).alias("_sums"), F.sum("_rows").alias(count or "_rows")
    )
    return grouped.withColumn(total, F.expr(f"if(size(_sums) = 0, null, {_number('_sums')})")).select(
        *keys, total, *([count] if count else [])
    )


def _number(sums: str) -> str:
    """The total as DOUBLE: its decimal text, read once."""
    def read(sign: str, mark: str) -> str:
        return f"transform(array({_text_of_limbs(sums, sign)}), n -> struct(n.carry as carry, concat('{mark}', n.carry, n.text) as text))[0]"

    return f"""transform(array(struct({read('', '')} as plus, {read('-', '-')} as minus)),
        b -> cast(concat(if(b.plus.carry < 0, b.minus.text, b.plus.text), 'E', {sums}[0].range * {DIGITS}) as double))[0]"""
