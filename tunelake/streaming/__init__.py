"""Structured Streaming over the growing sample log."""
