"""Operators that prepare training corpora. Nothing else in the library imports this subpackage."""
