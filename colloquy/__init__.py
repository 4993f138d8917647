"""Conversation analytics on Spark: DataFrame jobs over transcripts, activity and prices."""
