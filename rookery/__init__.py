"""rookery: analytics over conversation logs and document collections, as Spark jobs."""
