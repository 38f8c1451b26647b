"""Stored results: pair scores, benchmark histories and harvested terms."""
