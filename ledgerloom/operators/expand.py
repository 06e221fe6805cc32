"""Fan-out of requirements over templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(df: DataFrame, ids: str, out: str) -> DataFrame:
    """A row per id; rows without ids stay with null."""
    return df.withColumn(out, F.explode_outer(ids)).drop(ids)


def every_template(ids: DataFrame, templates: DataFrame, block: int = 10_000) -> DataFrame:
    """Every id with every template, which is the result that is asked for; repeated rows count, empty tables give none.

    The templates are dealt into blocks of some `block` rows by their hash and each block is a partner of every id, so no
    task holds more of them than a block; up to one block they are sent to all tasks.
    """
    count = templates.count()
    if count <= block:
        return ids.crossJoin(F.broadcast(templates))
    blocks = -(-count // block)
    dealt = templates.withColumn("_block", F.pmod(F.xxhash64(*templates.columns), F.lit(blocks)))
    return ids.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")
