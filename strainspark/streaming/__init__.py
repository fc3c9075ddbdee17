"""Incremental forms of the event operators (an addition: the domain has finished files only)."""
