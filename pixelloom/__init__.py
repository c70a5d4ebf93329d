"""Rasters, regions, palettes, masks and edit logs as relations on Spark."""
