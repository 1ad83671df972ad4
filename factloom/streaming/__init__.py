"""Incremental and streaming maintenance of fact tables."""
