"""Parameters that change results, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Defaults of the code; ``Settings.shipped()`` has those of the shipped configuration file."""

    seed_count: int = 5
    max_hop: int = 2
    active_threshold: float = 0.25
    hub_degree: int = 25
    neighbours_per_hop: int = 10
    hop_decay: float = 0.5
    alpha: float = 0.7
    beta: float = 0.3
    decay: float = 0.95
    pair_min_score: float = 0.15
    derived_increment: float = 0.3
    forget_below: float = 0.01
    hybrid: bool = True
    vector_share: float = 0.7
    lexical_share: float = 0.3
    k1: float = 1.5
    b: float = 0.75
    adaptive: bool = True
    floor: float = 0.15
    boost_max: float = 0.5
    boost_top: int = 3
    boost_factor: float = 0.3
    boost_minutes: int = 10
    boost_min_weight: float = 0.15
    dormant_below: float = 0.25
    reactivate_from: float = 0.50
    rescore_every: int = 50
    downscale: float = 0.90
    structural_min: float = 0.02
    stale_weight: float = 0.15
    stale_frequency: float = 1.0
    stale_hours: int = 48
    dormant_cycles: int = 3
    fire_base: float = 0.15
    fire_k: float = 0.075
    fire_steps: int = 5
    fire_epsilon: float = 1e-4
    phantom_min: float = 0.65
    phantom_per_node: int = 3
    phantom_total: int = 100
    same_concept: float = 0.65
    merge_from: float = 0.82
    source_min_score: float = 0.30

    @classmethod
    def shipped(cls) -> Settings:
        return replace(cls(), hub_degree=15, hybrid=False, floor=0.05)
