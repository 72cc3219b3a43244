"""rosterline: a PySpark-native engine for public-office roster data."""
