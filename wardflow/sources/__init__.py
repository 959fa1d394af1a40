"""Readers, projections to the column contract, and sinks."""
