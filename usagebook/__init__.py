"""Usage accounting for language-model session logs, as Spark jobs."""
