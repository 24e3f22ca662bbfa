"""What a study compares: targets, feature sets, models and split settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class StudySpec:
    targets: Mapping[str, Mapping[str, Sequence[str]]]
    models: Sequence[str] = ()
    grids: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    group_column: str | None = None
    grouping_enabled: bool | None = None
    test_ratio: float = 0.2
    cv_splits: int = 5
    seed: int = 42
    outer_repeats: int = 1
    class_boundaries: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    @property
    def grouped(self) -> bool:
        """Grouping is on when a group column is named, unless it is switched off explicitly."""
        return bool(self.group_column) if self.grouping_enabled is None else self.grouping_enabled

    def folds_for(self, model: str) -> int:
        """Folds of one model: its own setting, then the study's."""
        own = self.grids.get(model, {}).get("_cv_")
        return int(own) if own else self.cv_splits

    def rows(self) -> list[tuple[str, str, str, int]]:
        return [(t, s, f, i) for t, sets in self.targets.items() for s, features in sets.items() for i, f in enumerate(features)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``target, feature_set, feature, ordinal``."""
        return spark.createDataFrame(self.rows(), "target string, feature_set string, feature string, ordinal int")


def load_spec(path: str) -> StudySpec:
    """Read the study settings from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle) or {}
    split = raw.get("SPLIT", raw.get("split", {})) or {}
    evaluation = raw.get("evaluation", {}) or {}
    return StudySpec(
        targets=raw.get("TARGETS", {}) or {},
        models=list(raw.get("MODELS", raw.get("models", [])) or []),
        grids=raw.get("HYPERPARAMETERS", raw.get("grids", {})) or {},
        group_column=split.get("group_column"),
        grouping_enabled=split.get("grouping_enabled"),
        test_ratio=float(split.get("test_ratio", split.get("test_size", 0.2))),
        cv_splits=int(evaluation.get("cv_splits", 5)),
        seed=int(split.get("random_state", evaluation.get("random_state", 42))),
        outer_repeats=max(1, int(evaluation.get("nested_cv_outer_repeats", 1))),
        class_boundaries=(raw.get("classification", {}) or {}).get("class_boundaries", {}) or {},
    )
