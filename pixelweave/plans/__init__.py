"""Serialisable plans of several operators."""
