"""Operators over peaks, topics, similarities and graphs."""
