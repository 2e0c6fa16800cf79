"""Connected components, as the graph operators have them."""

from __future__ import annotations

from graphloom.operators.components import components

__all__ = ["components"]
