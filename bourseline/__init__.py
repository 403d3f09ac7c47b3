"""Spark-native analytics for daily prices, corporate actions and exchange news."""
