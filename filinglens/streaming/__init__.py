"""Incremental work: only what is new or stale is processed."""
