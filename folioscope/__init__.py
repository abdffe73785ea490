"""Document quality, scoring and traceability analytics expressed as Spark plans."""
