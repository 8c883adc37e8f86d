"""Texture and asset-package processing on Spark."""
