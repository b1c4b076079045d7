"""Text files, stored shards and registries, embedding and text-generation models."""
