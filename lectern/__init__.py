"""Topic and sentiment analytics over transcripts, written as Spark DataFrame operators."""
