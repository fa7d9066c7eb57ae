"""Telemetry views over the star-schema tables and the registered queries."""
