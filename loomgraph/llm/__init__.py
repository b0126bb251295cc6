"""Operators for training data built from source code, documentation and conversations."""
