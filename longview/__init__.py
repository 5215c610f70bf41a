"""Longitudinal entity analytics and evidence retrieval on Spark."""
