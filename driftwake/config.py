"""Analysis settings as frozen dataclasses; every operator takes them as literals in column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


# The published scoring weights, priors and thresholds.
@dataclass(frozen=True)
class ScoreConfig:
    iou: float = 0.40
    centroid: float = 0.25
    orientation: float = 0.25
    area: float = 0.10
    centroid_decay_km: float = 10.0
    orientation_span_deg: float = 90.0
    orientation_mode: str = "cos"


@dataclass(frozen=True)
class PriorConfig:
    temperature: float = 0.25
    trust_clean: float = 1.0
    trust_minor: float = 0.9
    trust_major: float = 0.6
    trust_identity: float = 1.3
    loitering: float = 1.25
    unexplained_slowdown: float = 1.20
    course_deviation: float = 1.15
    night_manoeuvring: float = 1.10
    ais_gap_in_aoi: float = 1.35
    proximity: float = 1.0
    gap_coincidence: float = 1.8
    prior_offence_weight: float = 0.4
    type_risk: tuple[tuple[str, float], ...] = (
        ("tanker", 1.40),
        ("bulk", 1.25),
        ("container", 1.00),
        ("cargo", 1.10),
        ("tug", 0.85),
        ("fishing", 0.70),
    )
    type_risk_default: float = 1.00


@dataclass(frozen=True)
class FayConfig:
    spreading_exponent: float = 0.75
    agreement_factor: float = 2.0
    reference_area_km2_at_1h: float = 18.0
    base_radius_m: float = 260.0


@dataclass(frozen=True)
class DriftConfig:
    wind_factor: float = 0.03
    wind_deflection_deg: float = 15.0
    timestep_min: float = 5.0
    diffusion_k_m2s: float = 5.0
    release_duration_min: float = 45.0


@dataclass(frozen=True)
class DetectionConfig:
    wind_gate_min_ms: float = 3.0
    wind_gate_max_ms: float = 10.0
    anomaly_sigmoid_offset: float = 1.5
    tile_px: int = 512
    tile_overlap_px: int = 64
    min_component_px: int = 64
    min_area_km2: float = 0.5
    cfar_k: float = 4.5
    cfar_guard: int = 4
    cfar_background: int = 12
    cfar_min_pixels: int = 5
    db_min: float = -30.0
    db_max: float = 0.0


@dataclass(frozen=True)
class BaselineConfig:
    cell_deg: float = 0.02
    min_scenes_for_local: int = 15
    sample_step: int = 16


@dataclass(frozen=True)
class TrustConfig:
    manoeuvre_sog_delta_kn: float = 3.0
    sog_disagreement_kn: float = 5.0
    ais_gap_min: float = 15.0
    teleport_kn: float = 60.0
    max_acceleration_ms2: float = 1.0
    duplicate_km: float = 1.0
    cost_info: float = 0.03
    cost_warn: float = 0.12
    cost_critical: float = 0.35


@dataclass(frozen=True)
class TierConfig:
    tier2_area_km2: float = 25.0
    tier3_area_km2: float = 150.0
    tier3_shore_eta_hours: float = 24.0
    tier2_shore_eta_hours: float = 72.0
    max_recipients: int = 6
    coverage_limit_km: float = 800.0


@dataclass(frozen=True)
class Config:
    score: ScoreConfig = field(default_factory=ScoreConfig)
    priors: PriorConfig = field(default_factory=PriorConfig)
    fay: FayConfig = field(default_factory=FayConfig)
    drift: DriftConfig = field(default_factory=DriftConfig)
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    baseline: BaselineConfig = field(default_factory=BaselineConfig)
    trust: TrustConfig = field(default_factory=TrustConfig)
    tier: TierConfig = field(default_factory=TierConfig)
    max_candidates: int = 12


DEFAULT = Config()
