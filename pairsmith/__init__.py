"""Preference-data engine on Spark."""
