"""Structured Streaming jobs: intake (K1/K2), live daily counts (K3), live subscribers (K4)."""

from .jobs import (  # noqa: F401
    event_stream,
    live_daily_counts,
    live_subscribers,
    read_daily_counts,
    read_subscribers,
    run_identity,
    run_available,
    search_intake_stream,
    subscriber_batch_writer,
    visit_intake_stream,
)
