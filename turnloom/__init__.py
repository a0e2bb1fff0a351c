"""Prepare and score multi-turn chat data as Spark DataFrame operations."""
