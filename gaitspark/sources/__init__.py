"""Readers, writers and generators."""

from .files import (
    append_annotations, append_ratings, append_runs, new_run, newest_version, read_annotation_log, read_episodes, read_motif_annotations, read_model, read_projection, read_roles, read_summary, save_index, save_model, upsert_motif_annotation, write_episodes, write_json, write_roles,
)
from .imports import arena_samples, gait_rows, register_sources, with_videos
from .synthetic import default_scenes, synthetic_tracks, synthetic_velocity

__all__ = [
    "append_annotations", "append_ratings", "append_runs", "arena_samples", "default_scenes", "gait_rows", "new_run", "newest_version", "read_annotation_log", "read_episodes", "read_model", "read_motif_annotations", "read_projection", "read_roles", "read_summary", "register_sources", "save_index", "save_model", "synthetic_tracks",
    "synthetic_velocity", "upsert_motif_annotation", "with_videos", "write_episodes", "write_json", "write_roles",
]
