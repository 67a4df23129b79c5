"""Subpackage of voicegrid."""
