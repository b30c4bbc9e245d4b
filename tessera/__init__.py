"""Span analytics over model-generated text, and operators for training data, on PySpark."""
