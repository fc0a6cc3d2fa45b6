"""pairlake: a PySpark-native engine for paired text and time-series data."""
