"""Operators over long (tidy) relations."""
