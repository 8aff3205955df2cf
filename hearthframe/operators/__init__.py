"""Relational, spatial, graph, statistical and index operators: pure functions of DataFrames and parameters."""
