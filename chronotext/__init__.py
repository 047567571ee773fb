"""chronotext: Spark-native analytics for time-aligned media text."""
