"""A PySpark-native engine for estimating combinatorial choice models."""
