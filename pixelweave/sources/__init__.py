"""Inputs: pixel relations derived from tables, and image files."""
