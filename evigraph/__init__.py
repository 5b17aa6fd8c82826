"""evigraph: an evidence-graph analytics engine on PySpark DataFrames."""
