"""Structured Streaming: incremental parity monitoring over arriving files."""

from equiloan.streaming.monitor import contingency_stream, run_monitor  # noqa: F401
