"""Element types: canonical names, the spellings of files and frameworks, widths, and little-endian codecs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ShardloreError

# Width in bytes of each canonical type.
WIDTHS = {"bool": 1, "u8": 1, "i8": 1, "i16": 2, "u16": 2, "f16": 2, "bf16": 2, "f32": 4, "i32": 4, "u32": 4, "f64": 8, "i64": 8, "u64": 8}
# Short spellings.
ALIASES = {"b": "bool", "f": "f32", "d": "f64"}
# The frameworks' names by a file's upper-case spelling. The first 13 are also canonical types.
FRAMEWORK = {
    "F64": "float64", "F32": "float32", "F16": "float16", "BF16": "bfloat16", "I64": "int64", "I32": "int32", "I16": "int16", "I8": "int8",
    "U64": "uint64", "U32": "uint32", "U16": "uint16", "U8": "uint8", "BOOL": "bool", "C64": "complex64", "F8_E4M3": "float8_e4m3fn", "F8_E5M2": "float8_e5m2",
}
#: What may be saved: 8-bit floats can be read, not written.
SAVED = {k for k in FRAMEWORK if not k.startswith("F8")}


class UnknownDtype(ShardloreError):
    pass


def parse(name: str) -> str:
    """The canonical name; any case, short spellings included."""
    low = name.lower()
    out = ALIASES.get(low, low)
    if out not in WIDTHS:
        raise UnknownDtype(f"unknown dtype: {low}")
    return out


def to_file(canonical: str) -> str:
    """A file's spelling. An unknown type counts as 32-bit floats, as readers of the format expect."""
    return canonical.upper() if canonical in WIDTHS else "F32"


def from_file(spelling: str) -> str:
    """The canonical name of a file's type, "unknown" if it has none here."""
    return spelling.lower() if spelling in FRAMEWORK and spelling.lower() in WIDTHS else "unknown"


def saved_spelling(name: str) -> str:
    """A file's spelling of what a framework or a file calls a type; exact, no other case."""
    for spelling, own in FRAMEWORK.items():
        if spelling in SAVED and name in (spelling, own):
            return spelling
    raise ValueError(f"unsupported dtype: {name}")


def framework_name(name: str, prefix: str = "torch") -> str | None:
    """float32 for F32, float32 and torch.float32."""
    return next((own for spelling, own in FRAMEWORK.items() if name in (spelling, own, f"{prefix}.{own}")), None)


def canonical(name: Column) -> Column:
    """The canonical name as a column, null if unknown."""
    known = {**{k: k for k in WIDTHS}, **ALIASES}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def width(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv]), canonical(name))


_NUMPY = {"bool": "?", "u8": "u1", "i8": "i1", "i16": "<i2", "u16": "<u2", "f16": "<f2", "f32": "<f4", "i32": "<i4", "u32": "<u4", "f64": "<f8", "i64": "<i8", "u64": "<u8"}


def _f8_e4m3() -> np.ndarray:
    """The 256 values: 4 bits of exponent with bias 7, 3 of fraction, no infinities, all ones is not a number."""
    byte = np.arange(256)
    e, m = byte >> 3 & 15, byte & 7
    value = np.where(e == 0, m / 8 * 2.0**-6, (1 + m / 8) * 2.0 ** (e - 7.0))
    return np.where(byte & 127 == 127, np.nan, np.where(byte > 127, -value, value)).astype(np.float32)


#: What numpy has no type for comes as float32.
_WIDENED = {
    "bf16": lambda b: (np.frombuffer(b, "<u2").astype("<u4") << 16).view("<f4"),
    "f8_e4m3": lambda b: _f8_e4m3()[np.frombuffer(b, np.uint8)],
    "f8_e5m2": lambda b: (np.frombuffer(b, np.uint8).astype("<u2") << 8).view("<f2").astype(np.float32),
}


def decode(data: bytes, dtype: str, shape: list[int] | None = None) -> np.ndarray:
    """Values of row-major little-endian bytes; an empty tensor gives zeros of its shape. dtype: a canonical or short name, or a file's spelling. bf16 and 8-bit floats become float32."""
    low = dtype.lower()
    name = low if low in _WIDENED or low == "c64" else parse(dtype)
    if shape is not None and 0 in shape:
        return np.zeros(shape, np.float32 if name in _WIDENED else "<c8" if name == "c64" else _NUMPY[name])
    if name in _WIDENED:
        out = _WIDENED[name](data)
    elif name == "c64":
        out = np.frombuffer(data, "<c8")
    else:
        out = np.frombuffer(data, _NUMPY[name])
    return out if shape is None else out.reshape(shape)


def encode(values: np.ndarray, dtype: str | None = None) -> tuple[list[int], str, bytes]:
    """(shape, file spelling, bytes). dtype "bf16" rounds float32 to nearest even."""
    if dtype and parse(dtype) == "bf16":
        bits = np.ascontiguousarray(values, "<f4").view("<u4")
        kept = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")
        kept = np.where(np.isnan(values), (bits >> 16).astype("<u2") | 0x40, kept).astype("<u2")
        return list(values.shape), "BF16", kept.tobytes()
    if values.dtype == np.complex64:
        return list(values.shape), "C64", np.ascontiguousarray(values, "<c8").tobytes()
    name = next((k for k, v in _NUMPY.items() if np.dtype(v) == values.dtype.newbyteorder("<")), None)
    if name is None:
        raise ValueError(f"unsupported dtype: {values.dtype}")
    return list(values.shape), to_file(name), np.ascontiguousarray(values, _NUMPY[name]).tobytes()
