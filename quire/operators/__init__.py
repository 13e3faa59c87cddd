"""Operators: tree rewriting and classification inside Arrow workers, relational ones as DataFrames."""
