"""Settings of the extraction pipeline."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class PipelineConfig:
    time_normalization: bool = True
    source_grounding: bool = True
    overlap_dedup: bool = True
    confidence_scoring: bool = True
    entity_resolution: bool = True
    relation_inference: bool = True
    kg_injection: bool = False
    confidence_threshold: float = 0.3
    overlap_threshold: float = 0.5
    entity_similarity_threshold: float = 0.7
    # Accepted, as files of settings have them, and without an effect on any stage.
    scope_window: int = 50
    type_aware_dedup: bool = False

    @classmethod
    def of(cls, given: dict | str | Path | None = None, **flags) -> PipelineConfig:
        """From a dict or a JSON file, which may nest them under pipeline_config; a file that isn't
        there gives the defaults, unknown keys are ignored."""
        if isinstance(given, (str, Path)):
            given = json.loads(Path(given).read_text(encoding="utf-8")) if Path(given).exists() else {}
        given = dict(given or {})
        given = given.get("pipeline_config", given) | flags
        return cls(**{f.name: given[f.name] for f in dataclasses.fields(cls) if f.name in given})
