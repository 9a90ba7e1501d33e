"""Operators on text for training language models."""
