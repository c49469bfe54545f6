"""Files in and out: datasets with metadata, the domain bundle, caches, runs and models."""
