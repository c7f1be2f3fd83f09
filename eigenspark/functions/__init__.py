"""Functions of one row, as Spark columns."""
