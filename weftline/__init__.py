"""Weftline: Spark-native bill-of-materials quality and footprint engine."""
