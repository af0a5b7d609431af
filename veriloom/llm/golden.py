"""Best representative of each duplicate group by weighted field votes.

Fields are unpivoted to long rows, every row votes for its normalised value
with source trust times recency decay, votes are summed per value, the winner
is taken with ``max_by`` and the fields are pivoted back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One field of the surviving record.

    value  -- what the winner delivers (any type, the same type over all fields)
    key    -- the normalised value that the vote goes to (cast to string)
    weight -- the vote, usually ``trust(rank) * decay(time)``, a whole number; a null vote does not count
    order  -- which of the rows that voted for the winning value delivers it: the largest (any type, the same over all
              fields; default the vote).  Equal ones are settled by the smallest tie.
    """

    name: str
    value: Column
    key: Column
    weight: Column
    order: Column | None = None


# Votes are exact integers (decimal 38), so a sum of many never rounds.
_LAST, _YEAR_US, _EPOCH_2000 = 30, 31_556_952_000_000, 946_684_800_000_000


def trust(rank: Column) -> Column:
    """Halves per rank: 2^(30 - rank), ranks held within 1 to 30; a missing rank counts as 30, the last."""
    r = F.least(F.greatest(F.coalesce(rank.cast("int"), F.lit(_LAST)), F.lit(1)), F.lit(_LAST))
    return F.pow(F.lit(2.0), F.lit(_LAST) - r).cast("decimal(10,0)")


def decay(time: Column, half_life_years: float = 1.0) -> Column:
    """Recency as a whole number that halves with every ``half_life_years`` of age.

    2^10 at the turn of 2000, within 1 and 2^56 (ages only matter among each other, so no date of today is needed);
    no date counts as the oldest, 1.
    """
    age = (F.unix_micros(time.cast("timestamp")) - F.lit(_EPOCH_2000)) / F.lit(_YEAR_US * half_life_years)
    power = F.least(F.greatest(F.lit(10.0) + age, F.lit(0.0)), F.lit(56.0))
    return F.floor(F.coalesce(F.pow(F.lit(2.0), power), F.lit(1.0))).cast("decimal(18,0)")


def best_record(df: DataFrame, group: str, tie: str, fields: list[Field]) -> DataFrame:
    """One row per ``group`` with the winning value of every field.

    Equal vote sums go to the value whose smallest ``tie`` is smallest; the
    value delivered is that of the row with the largest ``order``, then
    the smallest ``tie``.  A group none of whose rows votes for a field gets
    null there; rows with a null group are dropped; an empty table gives an
    empty result.  Redelivered rows must be removed before, they would vote twice.
    """
    base = df.filter(F.col(group).isNotNull())
    rows = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("field"), f.value.alias("value"), f.key.cast("string").alias("vkey"), f.weight.cast("decimal(38,0)").alias("vote"),
                (f.weight.cast("decimal(38,0)") if f.order is None else f.order).alias("order"),
            )
            for f in fields
        )
    )
    long = base.select(F.col(group).alias("__group"), F.col(tie).alias("__tie"), F.explode(rows).alias("__r")).select(
        "__group", "__tie", "__r.*"
    )
    votes = (
        long.filter(F.col("vote").isNotNull() & F.col("vkey").isNotNull())
        .groupBy("__group", "field", "vkey")
        .agg(
            F.sum("vote").alias("votes"),
            F.min("__tie").alias("first"),
            F.max_by("value", F.struct(F.col("order"), (-F.col("__tie")).alias("t"))).alias("value"),
        )
    )
    winners = votes.groupBy("__group").agg(
        *(
            F.max_by(F.when(F.col("field") == f.name, F.col("value")), F.when(F.col("field") == f.name, F.struct("votes", (-F.col("first")).alias("t")))).alias(f.name)
            for f in fields
        )
    )
    keys = base.select(F.col(group).alias("__group")).distinct()
    return keys.join(winners, "__group", "left").withColumnRenamed("__group", group)
