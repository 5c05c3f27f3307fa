"""File-catalog and cell-grid analytics on Spark DataFrames."""

from leafgrid.session import session

__all__ = ["session"]
