"""Recorded provider responses, the queries that normalise them, and their DuckDB SQL."""
