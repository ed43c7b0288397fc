"""Point-in-time entity features and leakage studies on Spark."""
