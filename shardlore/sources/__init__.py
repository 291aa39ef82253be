"""Scans and sinks of flat shards and of indexed partition layouts."""
