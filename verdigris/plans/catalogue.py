"""Every query of the library by name, and its SQL for the oracle."""

from __future__ import annotations

from verdigris.plans import folds_and_metrics, loads_and_frames, prompts_and_runs, sampling_and_turns, scalars, sources_and_sinks, stored_runs, streams, trends  # noqa: F401
from verdigris.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
