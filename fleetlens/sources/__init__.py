"""Readers and writers for snapshots, configuration documents and heartbeats."""
