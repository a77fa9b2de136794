"""Default thresholds. Every operator takes its own as an argument."""

from __future__ import annotations

from dataclasses import dataclass


# Results only agree with other users of these rules if the
# numbers and the node type list stay exactly as they are.
@dataclass(frozen=True)
class Thresholds:
    # spikes against the rolling baseline
    spike_pct: float = 30.0
    spike_min_daily_usd: float = 5.0
    spike_min_baseline_days: int = 3
    sustained_days: int = 2

    # severity of a spike by dollars above the baseline
    critical_delta_usd: float = 5000.0
    high_delta_usd: float = 500.0
    medium_delta_usd: float = 50.0

    # idle resources
    idle_cluster_min_usd: float = 1.0
    idle_resource_min_usd: float = 5.0
    idle_high_usd: float = 100.0
    max_auto_termination_minutes: int = 120

    # daily z-score, concentration and week-over-week findings
    zscore: float = 2.5
    zscore_high: float = 3.0
    zscore_min_days: int = 7
    sku_share_pct: float = 60.0
    wow_pct: float = 25.0
    wow_high_pct: float = 50.0

    # recommendations; the factors are the share of monthly cost saved
    rightsize_min_usd: float = 10.0
    rightsize_factor: float = 0.30
    autoscale_min_workers: int = 2
    autoscale_min_days: int = 3
    autoscale_min_cv: float = 0.4
    autoscale_min_usd: float = 20.0
    autoscale_factor: float = 0.20
    photon_min_dbu: float = 5.0
    photon_factor: float = 0.40
    serverless_min_usd: float = 10.0
    serverless_max_record_usd: float = 5.0
    serverless_factor: float = 0.25

    # budget alerts
    budget_alert_pct: float = 80.0
    overrun_pct: float = 10.0

    # policy
    untagged_min_usd: float = 1.0
    untagged_high_usd: float = 100.0
    untagged_medium_usd: float = 20.0
    expensive_node_types: tuple[str, ...] = (
        "Standard_E64s_v3",
        "Standard_E64s_v5",
        "Standard_M128s",
        "Standard_NC24s_v3",
        "Standard_ND40rs_v2",
    )


DEFAULTS = Thresholds()
