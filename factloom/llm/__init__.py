"""Operators for preparing text and code for language models. Nothing else in factloom imports this."""
