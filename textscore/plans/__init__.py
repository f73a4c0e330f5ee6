"""Whole evaluations put together from the functions and operators."""
