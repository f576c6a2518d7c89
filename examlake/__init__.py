"""Question-bank analytics on Spark: pages of exam-style text become a clean, queryable question bank."""
