"""DataFrame operators from chunks to shards."""
