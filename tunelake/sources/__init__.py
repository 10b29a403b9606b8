"""Readers and writers of the telemetry file formats.

Each reader is a file scan followed by a `parse_*` function on (path, text) rows,
so the same parsing serves texts that already are in a table.
"""
