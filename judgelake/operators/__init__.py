"""Operators over votes, verdicts, pairs, items and events: DataFrames in, DataFrames out."""
