"""Text-security analytics and corpus preparation on Apache Spark."""
