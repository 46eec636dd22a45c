"""Operators for preparing training data; optional, imported by nothing else of the package."""
