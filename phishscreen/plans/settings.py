"""Settings of a screen."""

from __future__ import annotations

from dataclasses import dataclass

ACTIONS = ("log_only", "tag_only", "mark_junk", "mark_and_move")


@dataclass(frozen=True)
class Settings:
    spam_threshold: int = 55
    gray_low: int = 35
    gray_high: int = 70
    weight_local: float = 0.3
    weight_model: float = 0.7
    body_limit: int = 1500
    action: str = "tag_only"
    second_opinion: bool = True
    self_domains: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    allow_addresses: tuple[str, ...] = ()
    block_domains: tuple[str, ...] = ()
    block_addresses: tuple[str, ...] = ()
    fix_raw_ip: bool = False
    log_limit: int = 500

    def __post_init__(self) -> None:
        if not (0 <= self.spam_threshold <= 100 and 0 <= self.gray_low < self.gray_high <= 100 and self.spam_threshold >= self.gray_low):
            raise ValueError("thresholds out of order")
        if min(self.weight_local, self.weight_model) < 0 or self.weight_local + self.weight_model <= 0:
            raise ValueError("weights must not be negative and not both 0")
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action}")
