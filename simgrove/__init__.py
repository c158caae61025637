"""Geometry of embedding collections on Spark: similarity forests, threshold filtrations, spectra, and the work around them."""
