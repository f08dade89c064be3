"""Readers and the relations derived from the driver's tables."""
