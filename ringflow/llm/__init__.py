"""Operators of a training-data pipeline, one module each; ``registry`` holds their queries."""
