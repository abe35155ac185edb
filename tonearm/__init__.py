"""tonearm: what a music library's data work needs, as Spark DataFrame and Structured Streaming operators."""
