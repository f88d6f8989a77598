"""Readers and writers: table scans, fixture derivation, seeding and sinks."""
