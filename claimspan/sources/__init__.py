"""Readers and writers: CSV inputs, stage tables and exports."""
