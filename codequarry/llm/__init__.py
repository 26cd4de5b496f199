"""Operators of a training-data pipeline: filtering, deduplication, mixing,
sharding, formatting and tokenisation of document tables.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL twins.
"""
