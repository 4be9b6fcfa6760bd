"""Operators of a training-data pipeline over large document tables."""
