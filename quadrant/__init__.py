"""quadrant: prepare, score and evaluate model completions for 2x2
matrix-product scripts, as Spark jobs."""

__version__ = "0.1.0"
