"""Structured Streaming: message ingest, conversation state, command batches."""
