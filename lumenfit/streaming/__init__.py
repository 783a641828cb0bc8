"""Scoring of arriving files with a saved pipeline."""
