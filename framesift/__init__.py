"""framesift: curated image datasets from video frame tables, as Spark jobs."""

__version__ = "0.1.0"
