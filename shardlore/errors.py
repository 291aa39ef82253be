"""Errors. What is wrong with a checkpoint's content is a ShardloreError, which is a ValueError; a missing path is a FileNotFoundError, a failed write an OSError."""


class ShardloreError(ValueError):
    pass
