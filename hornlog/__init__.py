"""A deductive query engine on Spark DataFrames."""

from .engine import Engine, EngineConfig, EvaluationOptions, Result
from .lang.diagnostics import Diagnostic

__all__ = ["Diagnostic", "Engine", "EngineConfig", "EvaluationOptions", "Result"]
