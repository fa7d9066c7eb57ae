"""Analytical operators, one module per kind of telemetry record."""
