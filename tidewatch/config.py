"""Engine settings; every threshold is a field, overridable from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Windowing, lateness and alert settings.

    ``first_report_seconds`` is how long after its end a window is first reported.
    """

    window_seconds: int = 300
    allowed_lateness_seconds: int = 720
    early_firing_seconds: int = 10
    stale_event_seconds: int = 86_400
    first_report_seconds: int = 60
    motor_running_threshold: float = 1.0
    running_ratio_alert: float = 0.95
    oil_temperature_alert: float = 70.0
    raw_topic: str = "readings.raw"
    features_topic: str = "readings.features"
    quarantine_topic: str = "readings.quarantine"
    too_late_topic: str = "readings.too_late"
    bootstrap_servers: str = "localhost:9092"

    @classmethod
    def from_env(cls, prefix: str = "TIDEWATCH_") -> "EngineConfig":
        """Fields named ``PREFIX + FIELD`` in the environment replace the defaults."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                found[f.name] = type(f.default)(raw)
        return replace(cls(), **found)
