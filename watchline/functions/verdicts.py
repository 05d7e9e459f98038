"""Column expressions for labels, severity, trust and protocol layers."""

from pyspark.sql import Column, functions as F

from ..config import DEFAULTS
from ..schemas import SEVERITIES

# Raw label words per class, exact first, then substrings.
BENIGN_VALUES = ("0", "normal", "benign", "false", "no", "clean")
SUSPICIOUS_VALUES = ("suspicious", "anomaly", "anomalous", "unknown", "suspect")
MALICIOUS_VALUES = (
    "1", "attack", "malicious", "true", "yes", "wiretap", "dos", "ddos", "mitm", "mirai",
    "fuzzing", "scan", "flood", "renegotiation", "injection", "exploit", "malware")
BENIGN_PARTS = ("benign", "normal")
SUSPICIOUS_PARTS = ("suspicious", "anomaly")
MALICIOUS_PARTS = ("attack", "malicious", "wiretap", "dos", "ddos", "mitm", "mirai", "scan",
                   "flood", "injection", "exploit")
ESCALATING_FLAGS = ("privilege_escalation", "remote_download")
LAYERS = {
    "ethernet": (1,), "arp": (1, 2), "icmp": (2,), "ip": (2,), "tcp": (2, 3), "udp": (2, 3),
    "http": (2, 3, 4), "https": (2, 3, 4), "ssh": (2, 3, 4), "ftp": (2, 3, 4), "dns": (2, 3, 4),
    "smtp": (2, 3, 4), "web": (2, 3, 4), "log": (4,), "syslog": (4,),
}
LAYER_COUNT = 4


def normalize_label(raw: Column) -> Column:
    """benign / suspicious / malicious, or null when the raw label says neither."""
    v = F.regexp_replace(F.lower(raw.cast("string")), r"(?U)^\s+|\s+$", "")
    return (
        F.when(v.isin(*BENIGN_VALUES), "benign")
        .when(v.isin(*SUSPICIOUS_VALUES), "suspicious")
        .when(v.isin(*MALICIOUS_VALUES), "malicious")
        .when(v.rlike("|".join(BENIGN_PARTS)), "benign")
        .when(v.rlike("|".join(SUSPICIOUS_PARTS)), "suspicious")
        .when(v.rlike("|".join(MALICIOUS_PARTS)), "malicious"))


def severity(label: Column, confidence: Column, flags: Column, cfg=DEFAULTS) -> Column:
    risky = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in ESCALATING_FLAGS]))
    return (
        F.when((label == "malicious") & (confidence >= cfg.critical_confidence), "critical")
        .when(label == "malicious", "high")
        .when((label == "suspicious") & risky, "high")
        .when(label == "suspicious", "medium")
        .otherwise("low"))


def explanation(label: Column, confidence: Column, flags: Column, allowlisted: Column) -> Column:
    named = F.when(F.size(flags) == 0, "none").otherwise(F.array_join(flags, ", "))
    text = F.format_string("Predicted as %s with confidence %.2f. Flags: %s.", label, confidence, named)
    return F.when(allowlisted, "Allowlisted activity.").otherwise(text)


def escalate(sev: Column) -> Column:
    """One tier up, capped at critical; an unknown tier counts as the lowest."""
    tiers = F.array(*[F.lit(s) for s in SEVERITIES])
    at = F.greatest(F.array_position(tiers, sev), F.lit(1))
    return F.element_at(tiers, F.least(at + 1, F.lit(len(SEVERITIES))).cast("int"))


def trust_multiplier(score: Column, cfg=DEFAULTS) -> Column:
    s = F.coalesce(score, F.lit(cfg.trust_initial))
    return F.when(s < cfg.trust_low, 1.5).when(s > cfg.trust_high, 0.8).otherwise(1.0)


def layers_of(service: Column) -> Column:
    """Protocol layers a service touches; empty array when the service is not known."""
    out = F.lit(None)
    for name, layers in LAYERS.items():
        hit = F.array(*[F.lit(x) for x in layers])
        out = F.when(F.lower(service) == name, hit).otherwise(out)
    return F.coalesce(out, F.array().cast("array<int>"))
