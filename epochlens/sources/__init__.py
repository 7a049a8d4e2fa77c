"""Payloads to rows: files and replies as they arrive, read into typed DataFrames."""
