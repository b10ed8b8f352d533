"""codeloom: corpus analysis (files, pages, documents) as Spark DataFrame jobs."""
