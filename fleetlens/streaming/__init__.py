"""Stateful processors and the streaming forms of the operators."""
