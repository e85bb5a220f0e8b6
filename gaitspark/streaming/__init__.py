"""Structured Streaming forms of the stateful operators."""

from .operators import latest_annotation_stream, run_available, scene_window_stream, session_stream
from .tracks import flush_tracks, track_stream, tracks_of

__all__ = ["flush_tracks", "latest_annotation_stream", "run_available", "scene_window_stream", "session_stream", "track_stream", "tracks_of"]
