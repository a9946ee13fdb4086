"""Column lineage over source corpora, expressed as Spark DataFrame jobs."""
