"""Structured Streaming: daily series filled up by deliveries."""
