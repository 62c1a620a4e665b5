"""Readers and writers of the formats that a curation pipeline meets."""
