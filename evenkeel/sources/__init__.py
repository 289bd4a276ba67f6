"""Readers of given tables and of the library's own log and record formats."""
