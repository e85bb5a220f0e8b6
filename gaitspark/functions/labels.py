"""Label layers and screening predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def effective_label(human: str = "human_label", machine: str = "machine_label", bio: str = "bio_label") -> Column:
    """The first of human, machine and legacy label that is not empty, else unknown."""
    return F.coalesce(_given(human), _given(machine), _given(bio), F.lit("unknown"))


def label_source(human: str = "human_label", machine: str = "machine_label") -> Column:
    """P2."""
    return F.when(_given(human).isNotNull(), "human").when(_given(machine).isNotNull(), "machine").otherwise("unannotated")


def qc_reasons(duration: Column, coverage: Column, distance: Column, min_duration: float = 3.0) -> Column:
    """Array of reasons against a query episode; an empty one means usable."""
    return F.filter(F.array(F.when(duration < min_duration, "short"), F.when(coverage < 0.7, "low_coverage"), F.when(distance < 1e-6, "no_motion")), lambda x: x.isNotNull())


def heuristic_label(aspect: Column, speed_cv: Column, pauses: Column, duration: Column) -> tuple[Column, Column]:
    """Label and confidence from body aspect and unsteadiness."""
    score = F.log(F.greatest(aspect, F.lit(1e-9))) - 0.35 * (speed_cv + pauses / F.greatest(duration, F.lit(1e-9)))
    label = F.when(score > 0.6, "ant").when(score < 0.4, "siler").otherwise("unknown")
    sure = F.when(score > 0.6, F.least(F.lit(0.95), 0.5 + 0.5 * (score - 0.6))).when(score < 0.4, F.least(F.lit(0.9), 0.5 + 0.3 * (0.4 - score))).otherwise(F.lit(0.3))
    return label, sure


def recalibrated_confidence(c: Column) -> Column:
    """S9."""
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + 0.45 * (c - 0.3) / 0.7))


def confidence_band(c: Column) -> Column:
    """P14."""
    return F.when(c >= 0.5, "high").when(c >= 0.15, "low").otherwise("none")


def normalize_class(name: Column) -> Column:
    """Detector classes by substring, ants first."""
    n = F.lower(F.trim(name))
    return F.when(n.contains("ant"), "ant").when(n.contains("spider"), "spider").when(n.isin("insect", "arthropod", "other"), n).otherwise("unknown")


def shamble_label(species: Column) -> Column:
    """Label of an imported species name; null for calibration objects and unknown ones."""
    return F.when(species.startswith("ANT"), "ant").when(species.contains("Myrmarachne"), "mimic").when(species.contains("Salticus"), "other_spider")


def trajectory_usable(coverage: Column, flags: Column) -> Column:
    """At least half of the frames have a place, and no flag tells of large gaps."""
    return (coverage >= 0.5) & ~F.coalesce(F.array_contains(flags, "large_gaps"), F.lit(False))


def interaction_label(human_only: bool = False, required: bool = False) -> Column:
    """The label an interaction works with: the effective one; the human one or unannotated with human_only; unannotated without a human one if it is required."""
    given = _given("human_label")
    if human_only:
        return F.coalesce(given, F.lit("unannotated"))
    label = effective_label()
    return F.when(given.isNull(), "unannotated").otherwise(label) if required else label


def is_reviewed(status: Column) -> Column:
    """P24."""
    return F.coalesce(status, F.lit("unreviewed")) != "unreviewed"


def clip_kind(has_video: Column, points: Column) -> Column:
    """What can be shown of an episode."""
    return F.when(has_video, "video").when(points > 0, "traj_replay").otherwise("gait_replay")


def similarity_level(d: Column) -> Column:
    """Mean absolute standardised difference in words."""
    return F.when(d < 0.35, "very high").when(d < 0.8, "high").when(d < 1.5, "moderate").otherwise("low")


def display_hour(clock: Column) -> Column:
    """Fractional hour of a 12-hour clock text; null where it isn't one."""
    t = F.try_to_timestamp(clock, F.lit("h:mm a"))
    return F.hour(t) + F.minute(t) / 60


def provenance_text(history: Column) -> Column:
    """The chain of processing steps in one line."""
    return F.array_join(F.transform(history, lambda h: F.concat_ws(" ", h["step"], h["model"], h["version"])), " -> ")
