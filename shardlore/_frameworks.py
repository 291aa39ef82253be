"""The model module's functions for one framework; `torch` and `tensorflow` offer them under that framework's name."""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace

from . import model


def surface(framework: str, device: str) -> SimpleNamespace:
    """load and iter functions with a framework and a usual device; open and save functions as they are, for they take any."""
    bound = {n: partial(getattr(model, n), framework=framework, device=device) for n in ("load_flat", "iter_flat", "load_indexed", "iter_indexed")}
    return SimpleNamespace(**bound, **{n: getattr(model, n) for n in ("open_flat", "open_indexed", "save_flat", "save_flat_bytes", "save_indexed")})
