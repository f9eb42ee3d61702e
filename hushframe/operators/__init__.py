"""DataFrame in, DataFrame out: matching, profiling, sampling, lookups, encoding, masking."""
