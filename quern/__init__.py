"""quern: a PySpark-native search and analytics engine over document collections."""
