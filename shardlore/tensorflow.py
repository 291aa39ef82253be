"""Checkpoints as tensors of tensorflow: load_*, iter_*, open_*, save_*, as in the model module."""

from __future__ import annotations

import importlib.util

from ._frameworks import surface

if importlib.util.find_spec("tensorflow") is None:
    raise ImportError("tensorflow is not installed")

_own = surface("tensorflow", "/CPU:0")
load_flat, iter_flat, open_flat = _own.load_flat, _own.iter_flat, _own.open_flat
load_indexed, iter_indexed, open_indexed = _own.load_indexed, _own.iter_indexed, _own.open_indexed
save_flat, save_flat_bytes, save_indexed = _own.save_flat, _own.save_flat_bytes, _own.save_indexed
