"""Evaluation of unbounded tables."""
