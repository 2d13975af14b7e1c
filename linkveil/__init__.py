"""linkveil: record-linkage encodings and their re-identification risk, as Spark DataFrame plans."""
