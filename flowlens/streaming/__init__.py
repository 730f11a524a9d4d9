"""Structured Streaming forms of the operators."""

from .transfers import ordered_or_late, recent_neighbors_stream, rolling_account_state, windowed_flows

__all__ = ["ordered_or_late", "recent_neighbors_stream", "rolling_account_state", "windowed_flows"]
