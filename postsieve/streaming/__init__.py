"""Structured Streaming forms of the ledger and of the incremental run."""
