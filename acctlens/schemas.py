"""Record schemas, settings with their defaults, and error codes."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"


class ErrorCode(str, Enum):
    """The stable error codes."""

    MINIMUMS_NOT_MET = "MINIMUMS_NOT_MET"
    ENGINE_TIMEOUT = "ENGINE_TIMEOUT"
    ENGINE_FAILURE = "ENGINE_FAILURE"
    BASELINE_CONFIG_MISMATCH = "BASELINE_CONFIG_MISMATCH"
    BASELINE_INVALID = "BASELINE_INVALID"
    LOCAL_MODEL_UNAVAILABLE = "LOCAL_MODEL_UNAVAILABLE"
    LOCAL_MODEL_INVALID = "LOCAL_MODEL_INVALID"
    EXTERNAL_NOT_ALLOWED = "EXTERNAL_NOT_ALLOWED"
    INPUT_INVALID = "INPUT_INVALID"
    ARTIFACT_INVALID = "ARTIFACT_INVALID"


class ContractError(ValueError):
    """Names a field and a code, never a value."""

    def __init__(self, name: str, code: ErrorCode = ErrorCode.INPUT_INVALID):
        super().__init__(f"{name}:{code.value}")
        self.field, self.code = name, code


def error_code_for(error: BaseException) -> str:
    return error.code.value if isinstance(error, ContractError) else ErrorCode.ENGINE_TIMEOUT.value if isinstance(error, TimeoutError) else ErrorCode.ENGINE_FAILURE.value


MESSAGES = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("game_id", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("timestamp_utc", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_system", T.BooleanType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_row", T.LongType()),
    ]
)


@dataclass(frozen=True)
class IngestSettings:
    field_map: dict = field(default_factory=dict)
    system_flag_field: str | None = None
    system_true_values: tuple[str, ...] = ("true", "1", "yes")
    dedupe: bool = True
    format: str = "auto"


@dataclass(frozen=True)
class PrepSettings:
    minimum_messages: int = 200
    minimum_chars: int = 5000
    idle_gap_minutes: int = 30
    chunk_mode: str = "characters"
    chunk_target: int = 1000
    retention_days: int = 7
    hours: tuple[int, ...] | None = None


@dataclass(frozen=True)
class StyleSettings:
    sizes: tuple[int, ...] = (2, 3, 4)
    hash_space: int = 262_144
    weights: tuple[float, float, float] = (0.50, 0.25, 0.25)
    seed: int = 1729


@dataclass(frozen=True)
class ChronoSettings:
    weights: tuple[float, float, float] = (0.45, 0.30, 0.25)


@dataclass(frozen=True)
class FusionSettings:
    weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
    epsilon: float = 0.0005


@dataclass(frozen=True)
class EvaluationSettings:
    split: tuple[float, float, float] = (0.6, 0.2, 0.2)
    min_precision: float = 0.80
    n_bootstrap: int = 1000
    ci_level: float = 0.95
    seed: int = 1729
