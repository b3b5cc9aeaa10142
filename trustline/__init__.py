"""Batch jobs that tell how far a speech recogniser's transcripts can be trusted."""
