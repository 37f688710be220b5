"""Connected components of an edge table, from the engine."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["components"]
