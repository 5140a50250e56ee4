"""Operators of a training-data pipeline: ten DataFrame-level operators and the queries that apply them."""
