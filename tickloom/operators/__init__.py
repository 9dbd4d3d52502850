"""Operators over bars, features, labels and trades."""
