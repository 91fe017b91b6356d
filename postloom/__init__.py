"""Spark jobs that turn collected web postings into clean text and topics."""
