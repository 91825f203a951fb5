"""The daily jobs as streams: bars from ticks, review dates, idempotent upserts, runs of signals."""

from .jobs import daily_bars, first_days, signal_sessions, upsert_batches

__all__ = ["daily_bars", "first_days", "signal_sessions", "upsert_batches"]
