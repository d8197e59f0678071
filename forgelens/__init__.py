"""forgelens: engineering-practice analytics over workflow corpora, as Spark jobs."""
