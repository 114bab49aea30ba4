"""newsloom: news-issue analytics as Spark DataFrame jobs."""
