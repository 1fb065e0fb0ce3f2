"""Profile, quality, cleaning, exploration, sales, anomaly and forecast operators."""
