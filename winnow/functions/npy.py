"""Reading NPY payloads and the names of patch files."""

from __future__ import annotations

import ast
import posixpath
import re
from urllib.parse import unquote

import numpy as np

MAGIC = b"\x93NUMPY"
RUN = re.compile(r"^cut_\w+$", re.I)
MOSAIC = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]([0-9]{5})\s*[+\-−–][0-9]{2}(?![0-9])")
LOOSE_MOSAIC = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]([0-9]{5})(?![0-9])")
#: Headers seen before; files of one writer share theirs.
_HEADERS: dict = {}
PATCH = re.compile(r"patch_0*([0-9]+)_0*([0-9]+)", re.I)


def _header(text: bytes, encoding: str) -> tuple[np.dtype, bool, tuple[int, ...]] | None:
    """(dtype, column-major, shape) of a header, or None if it is none."""
    if (text, encoding) in _HEADERS:
        return _HEADERS[text, encoding]
    if len(_HEADERS) > 4096:
        _HEADERS.clear()
    _HEADERS[text, encoding] = head = _parsed(text, encoding)
    return head


def _parsed(text: bytes, encoding: str) -> tuple[np.dtype, bool, tuple[int, ...]] | None:
    try:
        head = ast.literal_eval(text.decode(encoding).strip())
        dtype, shape = np.dtype(head["descr"]), head["shape"]
    except (ValueError, SyntaxError, TypeError, KeyError, MemoryError, RecursionError, UnicodeDecodeError):
        return None
    if not isinstance(shape, tuple) or not all(isinstance(n, int) and n >= 0 for n in shape):
        return None
    return (dtype, bool(head.get("fortran_order")), shape) if not dtype.hasobject else None


def read_npy(payload: bytes | None) -> np.ndarray | None:
    """The array of a payload of any format version, or None if it holds no complete array."""
    if not payload or payload[:6] != MAGIC or len(payload) < 10 or payload[6] not in (1, 2, 3):
        return None
    start = 10 if payload[6] == 1 else 12
    end = start + int.from_bytes(payload[8:start], "little")
    if len(payload) < end or end < start:
        return None
    head = _header(bytes(payload[start:end]), "utf-8" if payload[6] == 3 else "latin-1")
    if head is None:
        return None
    dtype, columns, shape = head
    count = 1
    for n in shape:
        count *= n
    if len(payload) - end < count * dtype.itemsize:
        return None
    flat = np.frombuffer(payload, dtype, count, end) if count and dtype.itemsize else np.zeros(count, dtype)
    return flat.reshape(shape, order="F" if columns else "C")


def canonical(array: np.ndarray) -> bytes:
    """Bytes that are equal for arrays of the same shape and values, whatever their type and layout."""
    shape = repr(array.shape).encode()
    if array.dtype.kind in "iu" and array.dtype.itemsize == 8 and array.size and np.abs(array.astype(np.float64)).max() > 2**53:
        return shape + b"i" + ",".join(map(str, array.ravel().tolist())).encode()
    if array.dtype.kind in "fiub":
        x = array.astype("<f8") + 0.0  # no negative zero
        x[np.isnan(x)] = np.nan
        return shape + b"f" + np.ascontiguousarray(x).tobytes()
    if array.dtype.kind == "c":
        return shape + b"c" + np.ascontiguousarray(array.astype("<c16") + 0.0).tobytes()
    return shape + array.dtype.str.encode() + np.ascontiguousarray(array).tobytes()


def patch_name(path: str | None) -> tuple[str, str, int, int] | None:
    """(run folder, five digits of the mosaic, row, column) of a patch file, however its path is spelt.

    Other separators, percent codes, blanks, detours, and folders, prefixes and suffixes from copying
    make no difference.  None for a path that names no patch.
    """
    if not path:
        return None
    parts = posixpath.normpath(unquote(path).replace("\\", "/").strip()).split("/")
    patch = PATCH.search(parts[-1])
    runs = [p.strip().lower() for p in parts[:-1] if RUN.match(p.strip())]
    others = [p for p in parts[:-1] if not RUN.match(p.strip())]
    mosaic = next((m for kind in (MOSAIC, LOOSE_MOSAIC) for p in others if (m := kind.search(p))), None)
    if not (patch and runs and mosaic):
        return None
    return runs[-1], mosaic[1], int(patch[1]), int(patch[2])
