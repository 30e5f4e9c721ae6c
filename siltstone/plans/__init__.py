"""Planning over manifests: which files to compact, which to read.  Plain Python, no Spark jobs."""
