"""Readers of feeds, configurations, scenarios and chain data, and table writers."""
