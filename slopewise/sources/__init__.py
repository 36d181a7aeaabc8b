"""Readers and writers of the table formats the operators use."""
