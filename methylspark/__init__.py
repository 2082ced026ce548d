"""Read-level DNA methylation around somatic variants, as PySpark DataFrame operators."""

__version__ = "0.1.0"
