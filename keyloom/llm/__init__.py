"""Operators for training data: texts, vectors and splits of a large corpus. Nothing else in the library imports this."""
