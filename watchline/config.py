"""Default thresholds, one dataclass; pass a changed copy to any operator."""

from dataclasses import dataclass

SECOND_US = 1_000_000


@dataclass(frozen=True)
class ThreatConfig:
    # The defaults every operator starts from.
    allowlist_ips: tuple = ("127.0.0.1",)
    allowlist_keywords: tuple = ("trusted_update", "backup_complete")
    allowlist_confidence: float = 0.99
    forward_labels: tuple = ("malicious",)
    dedup_window_s: float = 120.0
    critical_confidence: float = 0.85

    pattern_cooldown_s: float = 30.0
    pattern_buffer: int | None = None  # report at most this many buffered events
    pattern_idle_s: float = 600.0

    flood_rate: float = 100.0
    flood_window_s: float = 5.0
    flood_cooldown_s: float = 30.0
    blackhole_sigma: float = 3.0
    blackhole_tick_s: float = 60.0
    blackhole_history: int = 60
    blackhole_min_points: int = 5

    amof_history: int = 60
    amof_min_points: int = 6
    amof_threshold: float = 5.0
    amof_decay: float = 0.80
    amof_slopes: int = 10

    vote_confidence: float = 0.75
    vote_window_s: float = 300.0
    vote_depth: int | None = None  # keep at most this many votes of each (source, sniffer)
    consensus: float = 0.6

    sprt_p0: float = 0.01
    sprt_p1: float = 0.15
    sprt_alpha: float = 0.05
    sprt_beta: float = 0.10
    sprt_min_observations: int = 20
    sprt_cooldown_s: float = 120.0
    sprt_window: int | None = None  # report at most this many observations

    trust_initial: float = 0.7
    trust_malicious: float = -0.25
    trust_suspicious: float = -0.10
    trust_benign: float = 0.02
    trust_neighbour_weight: float = 0.3
    trust_cluster_weight: float = 0.4
    trust_outside_weight: float = 0.1
    trust_ttl_s: float = 3600.0
    trust_low: float = 0.3
    trust_high: float = 0.7

    affinity: float = 0.65
    clone_threshold: int = 3
    max_memory: int | None = None  # keep at most this many memory detectors
    antigen_dim: int = 512

    motion_window_s: float = 30.0
    motion_labels: tuple = ("malicious", "suspicious")
    recording_gap_s: float = 300.0

    safe_zone_purity: float = 0.90
    oversample_ratio: float = 0.5
    oversample_min: int = 10
    oversample_k: int = 5


DEFAULTS = ThreatConfig()


def micros(seconds: float) -> int:
    return int(round(seconds * SECOND_US))
