"""Presets and registered queries."""
