"""Operators over DataFrames: joins, claim checks, similarity, corpus statistics, reports."""
