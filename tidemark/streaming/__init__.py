"""Incremental work: classification of changed inputs, upserts, stalled runs, streams."""
