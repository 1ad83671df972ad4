"""Readers for fact tables, tool reports and source code."""
