"""Event clustering and feed queries over article tables, as Spark DataFrame operators."""
