"""The claims build and the queries that run over its result."""
