"""Listing analytics as Spark plans."""
