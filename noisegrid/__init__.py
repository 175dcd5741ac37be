"""Noise-exposure and trajectory analytics as Spark DataFrame operators."""
