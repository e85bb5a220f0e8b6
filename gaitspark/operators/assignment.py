"""J12, L4, T-4: gated costs, greedy assignment and gap filling as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..session import settled
from .tracking import TrackerSettings


def gated_costs(tracks: DataFrame, dets: DataFrame, settings: TrackerSettings | None = None) -> DataFrame:
    """(video_id, frame, track, detection, cost) of each pair within the gate.

    tracks: video_id, frame (the one to assign), track, last_frame, x, y (the expected
    place), x1, y1, x2, y2 (the last box). dets: video_id, frame, detection, x1, y1, x2, y2.
    The cost is the distance to the expected place less a bonus for overlap, at least 0; the gate is
    the jump times the frames since the last point. Pairs meet within a frame alone.
    """
    s = settings or TrackerSettings()
    a = tracks.select("video_id", "frame", "track", "last_frame", F.col("x").alias("_x"), F.col("y").alias("_y"), F.struct("x1", "y1", "x2", "y2").alias("_a"))
    b = dets.select("video_id", "frame", "detection", F.struct("x1", "y1", "x2", "y2").alias("_b"))
    pairs = a.join(b, ["video_id", "frame"])
    dx = (F.col("_b.x1") + F.col("_b.x2")) / 2 - F.col("_x")
    dy = (F.col("_b.y1") + F.col("_b.y2")) / 2 - F.col("_y")
    far = F.sqrt(dx * dx + dy * dy)
    gate = s.jump * F.greatest(F.col("frame") - F.col("last_frame"), F.lit(1))
    cost = F.greatest(far - s.iou_bonus * iou(F.col("_a"), F.col("_b")), F.lit(0.0))
    return pairs.where(far <= gate).select("video_id", "frame", "track", "detection", cost.alias("cost"))


def greedy_assignment(pairs: DataFrame, left: list[str], right: list[str], cost: str = "cost") -> DataFrame:
    """L4: the pairs that taking the cheapest free pair again and again would take.

    left and right name the columns that tell the two sides' nodes apart; where
    groups are matched on their own, both hold the group's columns. Equal costs go by
    left, then right; pairs with a null cost or node leave, and of repeated pairs the cheapest counts.

    A pair that is the first of all pairs at both of its nodes is taken by the greedy
    order, whatever happens elsewhere. So each round takes all such pairs at once, over
    all groups, and drops the pairs that touch their nodes; no group is gathered and
    nothing is sorted. Rounds follow the longest chain of pairs that wait for one another.
    """
    names = list(dict.fromkeys([*left, *right]))
    first = F.struct(F.col(cost), *names)
    complete = F.lit(True)
    for c in (*names, cost):
        complete = complete & F.col(c).isNotNull()
    now = settled(pairs.where(complete).groupBy(*names).agg(F.min(cost).alias(cost)), "pairs")
    taken: list[DataFrame] = []
    while now.take(1):
        at_left = now.groupBy(*left).agg(F.min(first).alias("_l"))
        at_right = now.groupBy(*right).agg(F.min(first).alias("_r"))
        # A pair that is first at both of its nodes is the first pair of some left node and of some right node.
        both = at_left.select(F.col("_l").alias("_p")).join(at_right.select(F.col("_r").alias("_p")), "_p")
        best = settled(both.select(*[F.col(f"_p.{c}").alias(c) for c in (*names, cost)]), "taken")
        taken.append(best)
        rest = now.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti")
        now = settled(rest, "pairs")
    out = now
    for t in taken:
        out = out.unionByName(t)
    return out.select(*names, cost)


def fill_gaps(points: DataFrame, most: int = 4, key: tuple[str, ...] = ("video_id", "track")) -> DataFrame:
    """T-4: points with the frames between two of a track that are at most ``most`` apart, on the straight line, flagged interpolated.

    points: key, frame, x, y, w, h, association, and more, which is null in filled rows. Filled points
    have the size of the point before, no confidence and half of the association of the point behind.
    """
    by = W.partitionBy(*key).orderBy("frame")
    then = {f"_{c}": F.lead(c).over(by) for c in ("frame", "x", "y", "association")}
    gaps = points.withColumns(then).withColumn("_n", F.col("_frame") - F.col("frame")).where(F.col("_n").between(2, most))
    inside = gaps.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - 1)))

    def on_line(c: str) -> Column:
        return F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_k") / F.col("_n")

    values = {"frame": F.col("frame") + F.col("_k"), "x": on_line("x"), "y": on_line("y"), "confidence": F.lit(0.0), "association": F.col("_association") * 0.5, "state": F.lit("interpolated")}
    kept = {*key, "w", "h"}
    cols = [values[c].cast(t).alias(c) if c in values else F.col(c) if c in kept else F.lit(None).cast(t).alias(c) for c, t in points.dtypes]
    return points.unionByName(inside.select(*cols))
