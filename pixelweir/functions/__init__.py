"""Decoding and scalar functions."""
