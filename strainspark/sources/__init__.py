"""Readers and writers of the domain's file formats."""
