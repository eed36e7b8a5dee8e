"""Text-authenticity analytics over tables and streams of documents, as Spark jobs."""
