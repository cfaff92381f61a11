"""Many boxes against many features: a join by cells of the Z-shaped curve.

A box is cut into a few cells of the grid level that fits its size; a cell of a level is one range of
the curve, that of all finer cells that share its leading bits. A feature lies in one cell per level,
so box and feature meet by equality of (level, cell), and the box is checked exactly afterwards.

A cell may have very many of both. Both are then cut into lots, and every lot of features meets every lot
of boxes in a group of its own, so that tasks are even in pairs, not in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propwell.functions.geometry import grid_x, grid_y, interleave
from propwell.operators.sinks import materialize
from propwell.operators.spread import width

_BOX = ("min_lng", "min_lat", "max_lng", "max_lat")
_CELL = ["_level", "_cell"]
#: About how many features or boxes of a cell one group holds.
LOT = 2048
#: About how many pairs one task compares.
TASK_PAIRS = 1 << 26


def box_cells(boxes: DataFrame) -> DataFrame:
    """`boxes` once per cell, with `_level` (trailing bits of an axis left off) and `_cell`.

    The level is the finest at which no side takes more than five cells, so a box of any size has at most 25.
    """
    edges = boxes.withColumns(
        {
            "_x0": grid_x(F.col("min_lng")), "_x1": grid_x(F.col("max_lng")),
            "_y0": grid_y(F.col("min_lat")), "_y1": grid_y(F.col("max_lat")),
        }
    )
    widest = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    # a number of n binary digits shifted by n - 2 is at most 3
    leveled = edges.withColumn("_level", F.greatest(F.length(F.bin(widest)) - 2, F.lit(0)))

    def cells(low: str, high: str) -> Column:
        return F.sequence(*[F.call_function("shiftright", F.col(c), F.col("_level")) for c in (low, high)])

    cut = leveled.withColumn("_x", F.explode(cells("_x0", "_x1"))).withColumn("_y", F.explode(cells("_y0", "_y1")))
    return cut.withColumn("_cell", interleave(F.col("_x"), F.col("_y"))).drop("_x", "_y", "_x0", "_x1", "_y0", "_y1")


def cell_lots(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells that have both: `_feature_lots` and `_box_lots`, how many lots each is cut into, and `_pairs`."""
    n_features, n_boxes = F.col("_n_features"), F.col("_n_boxes")
    both = features.groupBy(*_CELL).agg(F.count("*").alias("_n_features")).join(
        boxes.groupBy(*_CELL).agg(F.count("*").alias("_n_boxes")), _CELL
    )
    return both.select(
        *_CELL,
        F.ceil(n_features / LOT).alias("_feature_lots"),
        F.ceil(n_boxes / LOT).alias("_box_lots"),
        (n_features.cast("double") * n_boxes).alias("_pairs"),
    )


def in_lots(rows: DataFrame, lots: DataFrame, own: str, other: str) -> DataFrame:
    """`rows` of the cells of `lots`, each in a lot of its own side, once per lot of the other side.

    `_group` is one text: of several columns, or fields, one that is constant would drop out of the join's keys, and the
    join would deal the rows anew by their bytes.
    """
    joined = rows.join(lots.drop("_pairs"), _CELL)
    dealt = joined.withColumn(own, F.pmod(F.xxhash64("_deal"), F.col(f"{own}s")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)
    crossed = dealt.withColumn(other, F.explode(every))
    group = F.concat_ws("/", *_CELL, *sorted((own, other)))
    return crossed.withColumn("_group", group).drop(*_CELL, own, other, "_deal", f"{own}s", f"{other}s")


def bbox_join(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs of a box and a feature with every vertex inside it, edges included.

    `features` have `lng` and `lat`, or the bounds of `layers.with_bounds` (their lower corner is the
    place joined by). `boxes` have the same four bounds and are renamed `box_min_lng` and so on; other
    columns of the two must differ. Boxes that are null or empty (lower edge above the upper) and
    features without a place are in no pair. Only features within the extent of all boxes, a scalar
    subquery that reaches the scan, are dealt by cell, once per level that some box uses. Pairs per cell are
    counted first, which starts a job.
    """
    bounded = set(_BOX) <= set(features.columns)
    lng, lat = ("min_lng", "min_lat") if bounded else ("lng", "lat")
    top_lng, top_lat = ("max_lng", "max_lat") if bounded else ("lng", "lat")
    real = boxes.filter("min_lng <= max_lng AND min_lat <= max_lat")
    extent = {edge: real.agg(getattr(F, edge[:3])(edge)).scalar() for edge in _BOX}
    near = features.filter(
        (F.col(lng) >= extent["min_lng"]) & (F.col(top_lng) <= extent["max_lng"])
        & (F.col(lat) >= extent["min_lat"]) & (F.col(top_lat) <= extent["max_lat"])
    )
    cut = box_cells(real).withColumnsRenamed({edge: f"box_{edge}" for edge in _BOX})
    levels = cut.agg(F.array_sort(F.collect_set("_level"))).scalar()  # at most as many as the grid has bits
    placed = near.withColumn("_place", interleave(grid_x(F.col(lng)), grid_y(F.col(lat))))
    dealt = placed.withColumn("_deal", F.monotonically_increasing_id()).withColumn("_level", F.explode(levels))
    dealt = dealt.withColumn("_cell", F.expr("shiftright(_place, 2 * _level)")).drop("_place")
    cut = cut.withColumn("_deal", F.monotonically_increasing_id())
    lots = materialize(cell_lots(dealt, cut), "lots")
    pairs = lots.agg(F.sum("_pairs")).head()[0] or 0
    tasks = max(width(features.sparkSession), -(-int(pairs) // TASK_PAIRS))
    left = in_lots(dealt, lots, "_feature_lot", "_box_lot").repartition(tasks, "_group")
    right = in_lots(cut, lots, "_box_lot", "_feature_lot").repartition(tasks, "_group")
    inside = (
        (F.col(lng) >= F.col("box_min_lng")) & (F.col(top_lng) <= F.col("box_max_lng"))
        & (F.col(lat) >= F.col("box_min_lat")) & (F.col(top_lat) <= F.col("box_max_lat"))
    )
    # Spark takes a side that explodes for as small as it was, so the join is told to broadcast none
    return left.join(right.hint("merge"), "_group").filter(inside).drop("_group")
