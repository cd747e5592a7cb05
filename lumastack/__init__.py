"""Spark jobs for reflectance-imaging and photometric-stereo data."""
