"""Parameters of the detection-to-segment pipeline; fixed default values, all in seconds and shares of the picture."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    # physics gate
    min_points: int = 4
    min_r2: float = 0.80
    min_speed: float = 0.6
    window_sec: float = 0.7452
    use_gravity_band: bool = False
    max_curvature: float = 0.060
    min_curvature: float = 0.004
    min_span_y: float = 0.04
    y_down: bool = False
    max_jump: float = 0.10
    max_offset_y: float = 0.06
    reject_loops: bool = True
    loop_window_sec: float = 1.0
    loop_return_ratio: float = 0.5
    loop_min_excursion: float = 0.05
    # detections
    detection_confidence: float = 0.6021
    dedupe_radius: float = 0.02
    static_grid: int = 96
    static_distance: float = 0.01
    static_speed: float = 0.05
    static_streak: int = 8
    static_mute_sec: float = 10.0
    # tracker
    position_noise: float = 0.0003
    velocity_noise: float = 0.003
    measurement_noise: float = 0.01
    initial_position: float = 0.05
    initial_velocity: float = 0.1
    min_radius: float = 0.02
    radius_scale: float = 3.0
    area_points: int = 12
    strong_age: int = 5
    stale_sec: float = 2.0
    max_positions: int = 100
    # selection
    fresh_sec: float = 0.3
    size_weight: float = 0.10
    age_weight: float = 0.05
    age_reference: float = 12.0
    stickiness: float = 0.10
    # movement types
    classify: bool = True
    type_min_points: int = 5
    full_span_sec: float = 1.0
    airborne_physics: float = 0.7
    airborne_acceleration: float = 0.6
    airborne_smoothness: float = 0.6
    rolling_vertical: float = 0.3
    rolling_smoothness: float = 0.7
    rolling_acceleration: float = 0.4
    carried_inconsistency: float = 0.6
    carried_smoothness: float = 0.4
    gravity_curvature: float = 0.02
    min_gravity: float = 0.3
    veto_carried: bool = True
    # decider
    start_buffer: float = 0.1685
    end_timeout: float = 0.3978
    grace_frames: int = 5
    min_active_sec: float = 1.1653
    recent_sec: float = 1.0
    evidence_sec: float = 0.8
    sky_y: float = 0.85
    sky_timeout: float = 2.0
    # segments
    preroll: float = 2.0
    postroll: float = 0.5
    short_sec: float = 2.5
    short_preroll: float = 0.5
    merge_gap: float = 1.3513
    min_length: float = 2.6131
    # history limits
    max_trajectories: int = 500
    max_classifications: int = 1000
    max_validations: int = 2000

    def scaled(self, factor: float) -> Config:
        """All spans of time multiplied: for streams whose unit is not a second."""
        names = [f.name for f in fields(self) if f.name.endswith("_sec") or f.name in ("start_buffer", "end_timeout", "sky_timeout", "preroll", "postroll", "short_preroll", "merge_gap", "min_length")]
        return Config(**{f.name: getattr(self, f.name) * (factor if f.name in names else 1) for f in fields(self)})

    def problems(self) -> list[str]:
        """Names of values outside their ranges."""
        ranges = {"min_r2": (0, 1), "detection_confidence": (0, 1), "max_positions": (1, 1000), "max_trajectories": (1, 10000), "max_classifications": (1, 10000), "max_validations": (1, 10000)}
        return [name for name, (low, high) in ranges.items() if not low <= getattr(self, name) <= high]
