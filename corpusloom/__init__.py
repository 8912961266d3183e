"""corpusloom: an evidence-corpus engine expressed as Spark DataFrame jobs."""
