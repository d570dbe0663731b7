"""Territorial prioritisation analytics on Spark."""
