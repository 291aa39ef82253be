"""shardlore: catalogue, plan, convert and measure collections of named tensors with Spark."""

__version__ = "0.1.0"
