"""Hourly campaign tallies on Spark: change capture, envelopes, rollups, delivery."""
