"""Streaming forms of operators that take appended rows."""
