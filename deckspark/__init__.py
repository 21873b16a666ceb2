"""deckspark: a Spark-native corpus builder for trading-card decks."""
