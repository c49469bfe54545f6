"""Feature engineering and model evaluation for wide, string-heavy tables on Spark."""
