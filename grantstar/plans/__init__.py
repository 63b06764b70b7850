"""The pipeline stages and the analytics over the star."""
