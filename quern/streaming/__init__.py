"""The change feed, in batches and as a stream."""
