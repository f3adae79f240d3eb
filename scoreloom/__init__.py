"""Scoreloom: evaluation analytics on scored, grouped data, written for Spark."""
