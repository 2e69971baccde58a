"""Registered queries: each module has QUERIES (Spark) and ORACLES (ANSI SQL), keyed alike."""
