"""Operators: frames in, a frame out."""
