"""Readers that bring tables and native files into the engine's models."""
