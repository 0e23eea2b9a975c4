"""Streaming forms of counters, sales, likes, balances, limits and payment matching.

The builders take streaming (or batch) DataFrames and return the transformed
one; ``sinks`` runs them.  Event time is a TIMESTAMP in a UTC session.
"""
