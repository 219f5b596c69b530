"""Text and source-code statistics, comparison and reporting on Spark."""

__version__ = "0.1.0"
