"""quillon: a Spark-first analytics engine (relational, versioned, time-series, text, vector and JSON operators)."""
