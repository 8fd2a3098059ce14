"""Structured Streaming counterparts of the ledger operators."""
