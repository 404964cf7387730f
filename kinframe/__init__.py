"""kinframe: ancestry-graph analytics expressed as Spark DataFrame plans."""
