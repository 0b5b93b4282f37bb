"""Parameters of the trade-signal chain, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# Contract takers whose fills are dropped (fixed values).
CONTRACT_TAKERS = (
    "0x4bfb41d5b3570defd03c39a9a4d8de6bd8b8982e",
    "0xc5d563a36ae78145c45a50134d48a1215220f80a",
)

# The vocabulary of window features, in order (fixed values).
FEATURES = (
    "price_yes",
    "signed_token_amount",
    "usd_amount",
    "side",
    "role_is_maker",
    "time_delta_seconds",
    "market_age_seconds",
    "market_trade_count_1h",
    "market_volume_1h",
    "market_price_mean_1h",
    "market_price_std_1h",
    "market_price_return_1h",
    "user_trade_count_1h",
    "user_market_trade_count_1h",
    "user_signed_flow_1h",
    "user_usd_volume_1h",
)


@dataclass(frozen=True)
class Params:
    contract_takers: tuple[str, ...] = CONTRACT_TAKERS
    amount_decimals: int = 6
    horizon_minutes: int = 5
    max_future_lag_seconds: float | None = 300.0
    min_abs_bps: float = 5.0
    window: int = 50
    stride: int = 16
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    test_ratio: float = 0.1
    purge_minutes: int = 60
    embargo_minutes: int = 60
    features: tuple[str, ...] = FEATURES

    def __post_init__(self) -> None:
        if abs(self.train_ratio + self.validation_ratio + self.test_ratio - 1.0) > 1e-9:
            raise ValueError("the split ratios must sum to 1")
        if min(self.train_ratio, self.validation_ratio, self.test_ratio) < 0:
            raise ValueError("a split ratio is negative")
        if self.horizon_minutes <= 0 or self.window < 1 or self.stride < 1:
            raise ValueError("horizon, window and stride must be positive")
        if self.purge_minutes < 0 or self.embargo_minutes < 0 or self.min_abs_bps < 0:
            raise ValueError("purge, embargo and the least bps must not be negative")
        unknown = [f for f in self.features if f not in FEATURES]
        if unknown:
            raise ValueError(f"unknown features: {unknown}")


#: The parameters of the registered queries: the driver's streams are short.
QUERY_PARAMS = Params(
    contract_takers=("0xc1",), horizon_minutes=60, max_future_lag_seconds=None, min_abs_bps=5.0, window=8, stride=4,
    train_ratio=0.6, validation_ratio=0.2, test_ratio=0.2,
)

#: The parameters of the queries that need a validation split at every scale: shorter windows leave room between the cutoffs.
SPLIT_PARAMS = Params(
    contract_takers=("0xc1",), horizon_minutes=60, max_future_lag_seconds=None, min_abs_bps=5.0, window=3, stride=1,
    train_ratio=0.5, validation_ratio=0.3, test_ratio=0.2,
)
