"""Operators for training-data problems; nothing outside this subpackage imports it."""
