"""Settings, from the environment or given."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    cheap_model: str = "offline-cheap"
    frontier_model: str = "offline-frontier"
    agent_model: str = "offline-agent"
    max_tool_calls: int = 7
    chunk_tokens: int = 400
    overlap_tokens: int = 50
    candidates: int = 50
    fused: int = 20
    answers: int = 5
    near_duplicate: float = 0.95
    #: Rows of a tool's result that a model is shown at most.
    tool_rows: int = 50

    @classmethod
    def from_env(cls) -> Config:
        env = os.environ
        return cls(
            cheap_model=env.get("CHEAP_MODEL", cls.cheap_model),
            frontier_model=env.get("FRONTIER_MODEL", cls.frontier_model),
            agent_model=env.get("AGENT_MODEL", cls.agent_model),
            max_tool_calls=int(env.get("MAX_AGENT_TOOL_CALLS", cls.max_tool_calls)),
        )
