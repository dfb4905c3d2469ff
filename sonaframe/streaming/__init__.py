"""Structured Streaming jobs."""

from .jobs import (gap_segments_batch, gap_segments_stream, latest_rows, reject_counts_stream,  # noqa: F401
                   stream_gap_segments, stream_ingest_labels, stream_reject_counts,
                   stream_turns_until_exit, turns_until_exit_stream)
