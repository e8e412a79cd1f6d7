"""Operators of a training-data pipeline: each module holds one, its method named in the docstring."""
