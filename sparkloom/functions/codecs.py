"""Bit-level tensor codecs as NumPy functions and Arrow-batched column functions."""

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a 32-value MXFP4 block: one scale byte, sixteen bytes of packed nibbles.
MXFP4_BLOCK = 17
Q8_BLOCK = 32


def bf16_to_f32(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, dtype="<u2").astype(np.uint32) << 16).view(np.float32)


def e4m3_table() -> np.ndarray:
    """All 256 codes of FP8 E4M3. The code that stands for NaN decodes to +-448, as the checked artefacts have it."""
    code = np.arange(256)
    sign = np.where(code & 0x80, -1.0, 1.0)
    exponent, mantissa = code >> 3 & 15, code & 7
    value = np.where(exponent == 0, mantissa * 2.0**-9, (1 + mantissa / 8) * 2.0 ** (exponent - 7.0))
    return (sign * np.minimum(value, 448.0)).astype(np.float32)


def fp8_dequantized(codes: np.ndarray, scales: np.ndarray, block: int = 128) -> np.ndarray:
    """Rows of E4M3 codes times 2 ^ (scale - 127) of their square block."""
    s = np.exp2(scales.astype(np.float32) - 127)
    wide = np.repeat(np.repeat(s, block, axis=0), block, axis=1)[: codes.shape[0], : codes.shape[1]]
    return e4m3_table()[codes] * wide.astype(np.float32)


def q8_0(values: np.ndarray) -> bytes:
    """Blocks of 32: an f16 scale (max / 127) and 32 signed bytes, halves rounded away from zero, all in f32 steps."""
    x = values.astype(np.float32).reshape(-1, Q8_BLOCK)
    scale = (np.abs(x).max(axis=1) / np.float32(127)).astype(np.float32)
    inverse = np.where(scale > 0, np.float32(1) / np.where(scale > 0, scale, np.float32(1)), np.float32(0)).astype(np.float32)
    y = x * inverse[:, None]
    whole = np.floor(np.abs(y))
    q = (np.sign(y) * (whole + (np.abs(y) - whole >= np.float32(0.5)))).astype(np.int8)  # the remainder is exact, the sum with a half is not
    out = np.empty((len(x), 2 + Q8_BLOCK), dtype=np.uint8)
    out[:, :2] = scale.astype("<f2").view(np.uint8).reshape(-1, 2)
    out[:, 2:] = q.view(np.uint8)
    return out.tobytes()


def mxfp4_repacked(weights: np.ndarray, scales: np.ndarray) -> bytes:
    """Rows of packed nibbles (two neighbours in a byte, the first low) and block scales as 17-byte blocks: scale, then
    bytes that pair value i (low) with value i + 16 (high)."""
    halves = weights.astype(np.uint8).reshape(len(weights), -1, 2, 8)  # bytes of values 0 to 15 and 16 to 31
    low, high = halves[:, :, 0], halves[:, :, 1]
    out = np.empty((*low.shape[:2], MXFP4_BLOCK), dtype=np.uint8)
    out[:, :, 0] = scales.reshape(low.shape[:2])
    out[:, :, 1::2] = low & 15 | high << 4  # values of even places
    out[:, :, 2::2] = low >> 4 | high & 0xF0
    return out.tobytes()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bf16_floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bf16_to_f32(b).tolist())


@F.pandas_udf(T.StructType().add("size", T.LongType()).add("sha256", T.StringType()).add("data", T.StringType()))
def compressed_blob(raw: pd.Series) -> pd.DataFrame:
    """Size and digest of the bytes, and the bytes as base64 of zlib at its best level."""
    rows = [(None, None, None) if b is None else (len(b), hashlib.sha256(b).hexdigest(), base64.b64encode(zlib.compress(b, 9)).decode()) for b in raw]
    return pd.DataFrame(rows, columns=["size", "sha256", "data"])


@F.pandas_udf(T.BinaryType())
def blob_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda s: None if s is None else zlib.decompress(base64.b64decode(s)))


@F.pandas_udf(T.StructType().add("blocks", T.LongType()).add("high", T.LongType()).add("least", T.IntegerType()).add("most", T.IntegerType()))
def mxfp4_exponents(raw: pd.Series) -> pd.DataFrame:
    """Whole 17-byte blocks of a payload: how many, how many scales of 128 or more, the extreme scales."""
    out = []
    for b in raw:
        scale = np.frombuffer(b or b"", dtype=np.uint8)[: len(b or b"") // MXFP4_BLOCK * MXFP4_BLOCK].reshape(-1, MXFP4_BLOCK)[:, 0]
        out.append((len(scale), int((scale >= 128).sum()), int(scale.min()) if len(scale) else None, int(scale.max()) if len(scale) else None))
    return pd.DataFrame(out, columns=["blocks", "high", "least", "most"]).astype({"least": "Int32", "most": "Int32"})
