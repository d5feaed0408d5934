"""Intents, signals, strategies, policies and their weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals and scopes each monitoring intent needs.
INTENT_SIGNALS = {
    "check_enrollments": ["volume_patterns", "geographic_distribution", "temporal_patterns", "operator_activity"],
    "review_updates": ["update_frequency", "demographic_changes", "repeat_update_patterns", "address_change_velocity"],
    "verify_biometrics": ["biometric_update_frequency", "multi_device_submissions", "rejection_patterns", "quality_metrics"],
    "comprehensive_check": ["volume_patterns", "geographic_distribution", "temporal_patterns", "operator_activity",
                            "update_frequency", "demographic_changes", "biometric_update_frequency",
                            "cross_operation_correlation"],
}
INTENT_SCOPES = {
    "check_enrollments": ["new_registrations", "enrollment_volume", "center_activity"],
    "review_updates": ["demographic_updates", "address_changes", "field_modifications"],
    "verify_biometrics": ["fingerprint_updates", "iris_updates", "photo_updates"],
    "comprehensive_check": ["all_operations"],
}

# Weight of each signal.
SIGNAL_WEIGHTS = {
    "volume_patterns": 0.8, "geographic_distribution": 0.7, "temporal_patterns": 0.6, "operator_activity": 0.9,
    "update_frequency": 0.7, "demographic_changes": 0.8, "repeat_update_patterns": 0.9, "address_change_velocity": 0.7,
    "biometric_update_frequency": 0.95, "multi_device_submissions": 0.9, "rejection_patterns": 0.6,
    "quality_metrics": 0.5, "cross_operation_correlation": 0.8,
}

# Facts behind each signal and scope.
SIGNAL_SOURCES = {
    "volume_patterns": ["enrolment"], "geographic_distribution": ["enrolment", "demographic"],
    "temporal_patterns": ["enrolment"], "operator_activity": ["enrolment"],
    "update_frequency": ["demographic", "biometric"], "demographic_changes": ["demographic"],
    "repeat_update_patterns": ["demographic"], "address_change_velocity": ["demographic"],
    "biometric_update_frequency": ["biometric"], "multi_device_submissions": ["biometric", "enrolment"],
    "rejection_patterns": ["biometric"], "quality_metrics": ["biometric"],
    "cross_operation_correlation": ["enrolment", "demographic", "biometric"],
}
SCOPE_SOURCES = {
    "new_registrations": ["enrolment"], "enrollment_volume": ["enrolment"], "center_activity": ["enrolment"],
    "demographic_updates": ["demographic"], "address_changes": ["demographic"], "field_modifications": ["demographic"],
    "fingerprint_updates": ["biometric"], "iris_updates": ["biometric"], "photo_updates": ["biometric"],
    "all_operations": ["enrolment", "demographic", "biometric"],
}

# Strategies each signal points to, in catalogue order; weights; combination method and techniques.
STRATEGIES = ("behavioral_baseline", "regional_deviation", "pattern_consistency", "temporal_trend",
              "operator_profiling", "cross_reference", "volume_surge", "quality_assessment")
SIGNAL_STRATEGIES = {
    "volume_patterns": ["volume_surge", "behavioral_baseline"], "geographic_distribution": ["regional_deviation"],
    "temporal_patterns": ["temporal_trend", "behavioral_baseline"],
    "operator_activity": ["operator_profiling", "behavioral_baseline"],
    "update_frequency": ["pattern_consistency", "temporal_trend"],
    "demographic_changes": ["pattern_consistency", "cross_reference"],
    "biometric_update_frequency": ["quality_assessment", "operator_profiling"],
    "cross_operation_correlation": ["cross_reference"],
}
STRATEGY_WEIGHTS = {
    "behavioral_baseline": 0.25, "regional_deviation": 0.20, "pattern_consistency": 0.20, "temporal_trend": 0.10,
    "operator_profiling": 0.25, "cross_reference": 0.15, "volume_surge": 0.15, "quality_assessment": 0.10,
}
STRATEGY_METHODS = {
    "behavioral_baseline": ("averaging", 0.7, ["isolation_forest", "autoencoder"]),
    "regional_deviation": ("voting", 0.65, ["hdbscan", "lof"]),
    "pattern_consistency": ("stacking", 0.75, ["autoencoder", "isolation_forest"]),
    "temporal_trend": ("averaging", 0.6, ["moving_avg", "exp_smooth"]),
    "operator_profiling": ("voting", 0.8, ["isolation_forest", "lof"]),
    "cross_reference": ("stacking", 0.7, ["hdbscan", "autoencoder"]),
    "volume_surge": ("voting", 0.6, ["zscore", "iqr"]),
    "quality_assessment": ("averaging", 0.65, ["autoencoder", "one_class_svm"]),
}
VIGILANCE_RISK = {"routine": 0.85, "standard": 1.0, "enhanced": 1.15, "maximum": 1.3}
VIGILANCE_CUT = {"routine": 1.3, "standard": 1.0, "enhanced": 0.8, "maximum": 0.6}

# Fixed values: (review, flag, escalate) cuts per tolerance; presets.
POLICY_CUTS = {"conservative": (0.4, 0.6, 0.85), "balanced": (0.5, 0.7, 0.9), "aggressive": (0.6, 0.8, 0.95)}
POLICY_PRESETS = {"HIGH_SECURITY": "conservative", "STANDARD": "balanced", "HIGH_THROUGHPUT": "aggressive",
                  "SPECIAL_DRIVE": "balanced"}

# Technical words and their plain replacements, applied in order.
TERMS = {
    "anomaly": "irregularity", "anomaly score": "concern level", "outlier": "exception", "cluster": "pattern group",
    "prediction": "assessment", "feature": "indicator", "threshold": "standard", "model": "system",
    "algorithm": "process", "dataset": "records", "z-score": "deviation level", "mean": "average",
    "variance": "spread", "correlation": "relationship",
}


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small constant table, NULL when absent."""
    items: list[Column] = []
    for k, v in table.items():
        items.append(F.lit(k))
        items.append(F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v))
    return F.try_element_at(F.create_map(*items), key)


def values_sql(table: Mapping[str, Sequence[str] | float]) -> str:
    """The same table as SQL rows (key, value)."""
    rows = []
    for k, v in table.items():
        rows += [f"('{k}','{x}')" for x in v] if isinstance(v, (list, tuple)) else [f"('{k}',{v}e0)"]
    return "(VALUES " + ",".join(rows) + ")"
