"""Palimpsest: a PySpark-native engine that turns noisy page text into clean training data."""
