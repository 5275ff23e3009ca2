"""Analytics over model evaluations and training corpora, written as Spark jobs."""
