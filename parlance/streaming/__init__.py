"""Stateful rules over streams."""
