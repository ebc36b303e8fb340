"""Who reacts to whom: giver-by-receiver counts and row percentages.

The matrix is kept in long form: a pair without a row is a zero. That is the whole
matrix, and it grows with the reactions rather than with the square of the members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.plans.hot_keys import MIN_HOT_ROWS
from agorametrics.plans.joins import join_cut
from agorametrics.plans.positions import with_position
from agorametrics.plans.tables import write_once

def numbered_members(members: DataFrame) -> DataFrame:
    """``members(author_id)`` with matrix positions in id order."""
    return with_position(members.select("author_id"), "author_id")


def reaction_matrix(reactions: DataFrame, members: DataFrame) -> DataFrame:
    """Cells between members: ids, positions and count.

    ``members(author_id, position)`` gives the positions. Both ends must be members.
    """
    givers = members.select(
        F.col("author_id").alias("giver_id"), F.col("position").alias("giver_index")
    )
    receivers = members.select(
        F.col("author_id").alias("receiver_id"), F.col("position").alias("receiver_index")
    )
    return (
        reactions.join(givers, "giver_id")
        .join(receivers, "receiver_id")
        .select("giver_id", "receiver_id", "giver_index", "receiver_index", "reaction_count")
    )


def reaction_percentages(cells: DataFrame, hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Each cell as a percentage of what its giver gave.

    The row sums are aggregated and joined back, with givers of very many cells cut into
    pieces; a window would hold all cells of a giver in one task.
    """
    table = write_once(cells.select("giver_id", "receiver_id", "reaction_count"), "cells")
    rows = table.groupBy("giver_id").agg(F.sum("reaction_count").alias("given"))
    share = F.coalesce(
        F.try_divide(F.col("reaction_count").cast("double"), F.col("given").cast("double")),
        F.lit(0.0),
    )
    return join_cut(table, rows, "giver_id", "receiver_id", hot_rows).select(
        "giver_id", "receiver_id", (share * 100).alias("percentage")
    )


def dense_rows(cells: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """(giver_id, row): an array per member with a value per member in order of position.

    ``members(author_id, position)`` gives the order. A row is as long as there are members;
    the long form has the non-zero cells only.
    """
    size = members.agg(F.count("*")).scalar()
    zero = F.lit(0).cast(cells.schema[value].dataType)
    receivers = members.select(F.col("author_id").alias("receiver_id"), "position")
    filled = cells.join(receivers, "receiver_id").groupBy("giver_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("value")))).alias("cells")
    )
    # Zeros between the sorted cells, and behind the last one.
    last = F.struct(F.col("size").alias("position"), zero.alias("value"))
    stops = F.concat(F.coalesce("cells", F.array().cast(filled.schema["cells"].dataType)), F.array(last))
    gaps = F.transform(
        stops,
        lambda c, i: F.concat(
            F.array_repeat(
                zero, (c["position"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(stops, i - 1)["position"]) - 1).cast("int")
            ),
            F.array(c["value"]),
        ),
    )
    return (
        members.select(F.col("author_id").alias("giver_id"))
        .join(filled, "giver_id", "left")
        .withColumn("size", size)
        .select("giver_id", F.slice(F.flatten(gaps), F.lit(1), F.col("size").cast("int")).alias("row"))
    )


def figure_size(users: Column) -> Column:
    """Edge length of the heat map for a number of users."""
    return F.greatest(F.lit(fixed.MATRIX_MIN_FIGURE), users * fixed.MATRIX_FIGURE_PER_USER)
