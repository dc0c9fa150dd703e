"""Planning of shuffles: strategy, buffers, aggregation tree, codec, placement, estimates."""
