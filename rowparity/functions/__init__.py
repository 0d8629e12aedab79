"""Column functions: canonical encoding, hashing, buckets."""
