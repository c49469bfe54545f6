"""Multi-job building blocks that keep each task bounded whatever the key distribution."""
