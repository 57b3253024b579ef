"""concordat: declarative record reconciliation as Spark jobs."""

__version__ = "0.1.0"
