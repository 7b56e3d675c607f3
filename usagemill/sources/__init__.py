"""Readers that turn agent logs into the canonical usage table."""
