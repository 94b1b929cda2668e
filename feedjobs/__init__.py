"""feedjobs: Spark jobs that turn fetched web content into a current, deduplicated feed."""
