"""Operators for large training-data pipelines: filtering, de-duplication, decontamination, packing and output."""
