"""Market-bar analytics as Spark plans: bars, features, labels, trades, risk."""
