"""Operators for building training data at scale: ten of them, one module each."""
