"""codelake: Spark jobs for capturing, structuring, indexing and searching source corpora."""
