"""SHA-256 whose state can be handed on: OpenSSL's own, as the bytes of its context."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8),
        ("bits", ctypes.c_uint32 * 2),
        ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint),
        ("md_len", ctypes.c_uint),
    ]


def _library() -> ctypes.CDLL:
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)  # and the libcrypto that it is linked with


def resumed(state: bytes | None, pieces: Iterable[bytes]) -> bytes:
    """The state after ``pieces`` that follow what led to ``state`` (None: nothing yet)."""
    library, context = _library(), _Context()
    if state is None:
        library.SHA256_Init(ctypes.byref(context))
    else:
        context = _Context.from_buffer_copy(state)
    for piece in pieces:
        library.SHA256_Update(ctypes.byref(context), ctypes.c_char_p(piece), ctypes.c_size_t(len(piece)))
    return bytes(context)


def finished(state: bytes) -> str:
    """The digest of all that led to ``state``, in hexadecimal digits."""
    context, digest = _Context.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _library().SHA256_Final(digest, ctypes.byref(context))
    return digest.raw.hex()
