"""Readers and writers: batches, documents, snapshots."""
