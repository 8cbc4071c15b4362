"""driftframe: a PySpark-native analytics engine for vehicle motion data."""
