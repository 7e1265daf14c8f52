"""DataFrame-in, DataFrame-out operators, each batched by a key."""
