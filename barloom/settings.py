"""Every tunable number in one frozen object; operators take it as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

BEAR, SIDEWAYS, BULL = 0, 1, 2
REGIME_NAMES = {BEAR: "BEAR", SIDEWAYS: "SIDEWAYS", BULL: "BULL"}


@dataclass(frozen=True)
class Gate:
    buy: float
    sell: float
    size: float


@dataclass(frozen=True)
class Settings:
    # Annualisation and risk-free rate.
    trading_days: int = 252
    risk_free: float = 0.065

    # Indicator look-backs.
    ma_short: int = 20
    ma_medium: int = 50
    ma_long: int = 200
    ema_fast: int = 12
    ema_slow: int = 26
    macd_signal: int = 9
    rsi: int = 14
    roc: int = 10
    stoch_k: int = 14
    stoch_d: int = 3
    band: int = 20
    band_sigmas: float = 2.0
    atr: int = 14
    vol: int = 20
    volume_ma: int = 20

    # Quality gates.
    min_rows: int = 100
    max_missing: float = 0.12
    max_move: float = 0.50
    quality_fill: int = 3
    return_fill: int = 2

    # Vote weights and regime gates.
    weights: dict = field(
        default_factory=lambda: {
            "trend": 0.30,
            "momentum": 0.30,
            "mean_reversion": 0.20,
            "volume": 0.20,
        }
    )
    gates: dict = field(
        default_factory=lambda: {
            "BULL": Gate(0.30, 0.50, 1.00),
            "SIDEWAYS": Gate(0.40, 0.40, 0.70),
            "BEAR": Gate(0.50, 0.25, 0.50),
        }
    )
    soft_gate: bool = True

    # Trading costs and sizing.
    cost: float = 0.001
    position_cap: float = 0.10
    slots: int = 8
    capital: float = 100_000.0

    # Short-list floors.
    confidence_floor: float = 0.30
    score_floor: float = 0.28
    min_agreement: int = 2
    lookback: int = 504
    max_hold: int = 40

    # Fixed value: seconds a quote stays fresh.
    quote_ttl: int = 60

    @property
    def rf_daily(self) -> float:
        return (1.0 + self.risk_free) ** (1.0 / self.trading_days) - 1.0

    def normalised_weights(self) -> dict:
        total = sum(self.weights.values())
        if abs(total - 1.0) <= 1e-6:
            return dict(self.weights)
        return {k: v / total for k, v in self.weights.items()}

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
