"""Readers, writers, model persistence and the run registry."""
