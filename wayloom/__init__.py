"""wayloom: PySpark-native analytics over movement data."""
