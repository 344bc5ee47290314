"""Operators that prepare data for language models. Nothing else in the library imports this subpackage."""
