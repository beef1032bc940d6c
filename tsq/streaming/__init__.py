"""Structured Streaming ingestion and evaluation."""
