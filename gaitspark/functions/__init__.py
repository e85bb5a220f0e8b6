"""Column functions: geometry, labels, predicates."""

from .geometry import (
    bearing_sector, circular_mean_deg, cosine_distance, decay_prediction, euclidean, heading_diff_deg, interpolate, iou, population_z, similarity, to_uint8, wrap_angle,
)
from .labels import (
    clip_kind, confidence_band, display_hour, effective_label, heuristic_label, label_source, normalize_class, provenance_text, qc_reasons, recalibrated_confidence, shamble_label, similarity_level,
)

__all__ = [
    "bearing_sector", "circular_mean_deg", "clip_kind", "confidence_band", "cosine_distance", "decay_prediction", "display_hour", "effective_label", "euclidean", "heading_diff_deg", "heuristic_label",
    "interpolate", "iou", "label_source", "normalize_class", "population_z", "provenance_text", "qc_reasons", "recalibrated_confidence", "shamble_label", "similarity", "similarity_level", "to_uint8", "wrap_angle",
]
