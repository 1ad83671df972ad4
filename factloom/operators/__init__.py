"""Operators on fact tables: graph rounds, hierarchies, keyed aggregation, joins."""
