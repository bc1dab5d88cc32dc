"""emberline: candle analytics and alerts as Spark DataFrame programs."""
