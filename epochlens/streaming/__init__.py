"""Polled feeds as streams: exactly-once ingest, late data, finished bars, the hand-off of new rows."""
