"""Streaming: the feed kept current as raw items arrive."""
