"""Small binary records: trailer sections, wrap sets, tokens, one-time codes, keyed block permutations."""

from __future__ import annotations

import hashlib
import hmac
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import table_of

#: Names of trailer sections.
SECTIONS = ("PMSG", "ENGR", "TOTP", "PKEY", "FBOX", "CLAM", "PART", "ARCV")
MOST_WRAPS, MOST_VARIANTS, MOST_REFS = 16, 8, 32
#: Layout of a token before its claims: version, epoch it was issued in, window of epochs, uses left, size of the claims.
TOKEN = struct.Struct("<BIIHH")
MOST_CLAIMS = 4096


def write_sections(sections: list[tuple[str, bytes]]) -> bytes:
    return b"".join(name.encode().ljust(4)[:4] + len(body).to_bytes(4, "little") + body for name, body in sections)


def read_sections(data: bytes) -> dict[str, bytes]:
    """Sections by name; of several with one name the first. Stops where a section is cut short."""
    out: dict[str, bytes] = {}
    at = 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            break
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.BinaryType()))
def sections(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else read_sections(bytes(x)))


def write_wraps(wraps: list[tuple[int, bytes]], variants: list[tuple[str, int, int, int]] = (), refs: list[tuple[bytes, int]] = ()) -> bytes:
    """wraps: type, body; variants: name, type, offset, size; refs: hash, kind (0 embedded, 1 external, 2 network)."""
    if len(wraps) > MOST_WRAPS or len(variants) > MOST_VARIANTS or len(refs) > MOST_REFS:
        raise ValueError("too many entries")
    out = [struct.pack("<4I", len(wraps), len(variants), len(refs), 0)]
    out += [struct.pack("<II", kind, len(body)) + body for kind, body in wraps]
    out += [struct.pack("<32sIQQ", name.encode()[:31], kind, offset, size) for name, kind, offset, size in variants]
    out += [struct.pack("<32sI", digest, kind) for digest, kind in refs]
    return b"".join(out)


def read_wraps(data: bytes) -> dict[str, list]:
    """Wraps, variants and refs; counts beyond the bounds are cut, and reading stops where data ends."""
    out: dict[str, list] = {"wraps": [], "variants": [], "refs": []}
    if len(data) < 16:
        return out
    counts = struct.unpack_from("<3I", data)
    at = 16
    for _ in range(min(counts[0], MOST_WRAPS)):
        if at + 8 > len(data):
            return out
        kind, size = struct.unpack_from("<II", data, at)
        if at + 8 + size > len(data):
            return out
        out["wraps"].append((kind, data[at + 8 : at + 8 + size]))
        at += 8 + size
    for name, layout, most in (("variants", "<32sIQQ", MOST_VARIANTS), ("refs", "<32sI", MOST_REFS)):
        record = struct.Struct(layout)
        for _ in range(min(counts[1 + (name == "refs")], most)):
            if at + record.size > len(data):
                return out
            row = record.unpack_from(data, at)
            out[name].append((row[0].rstrip(b"\0").decode("utf-8", "replace"), *row[1:]) if name == "variants" else row)
            at += record.size
    return out


def write_token(epoch: int, window: int, uses: int, claims: bytes) -> bytes:
    if len(claims) > MOST_CLAIMS:
        raise ValueError("claims are too long")
    return TOKEN.pack(1, epoch, window, uses, len(claims)) + claims


def read_token(data: bytes) -> tuple[int, int, int, bytes]:
    if len(data) < TOKEN.size or data[0] != 1:
        raise ValueError("no token")
    _, epoch, window, uses, size = TOKEN.unpack_from(data)
    if size > MOST_CLAIMS or len(data) != TOKEN.size + size:
        raise ValueError("the claims' size is wrong")
    return epoch, window, uses, data[TOKEN.size :]


def one_time_code(secret: bytes, seconds: int, step: int = 30, digits: int = 6) -> str:
    """Time-based code of RFC 6238 with SHA-1."""
    mac = hmac.new(secret, struct.pack(">Q", seconds // step), hashlib.sha1).digest()
    at = mac[-1] & 15
    return str((int.from_bytes(mac[at : at + 4], "big") & 0x7FFFFFFF) % 10**digits).zfill(digits)


def code_fits(secret: bytes, code: str, seconds: int, step: int = 30) -> bool:
    """The code of the current step, or of the one before or after."""
    return any(hmac.compare_digest(code, one_time_code(secret, seconds + d * step, step, len(code))) for d in (-1, 0, 1) if seconds + d * step >= 0)


def _order(blocks: int, key: bytes) -> list[int]:
    return sorted(range(blocks), key=lambda i: hashlib.sha3_256(key + i.to_bytes(8, "little")).digest())


def shuffle_blocks(data: bytes, key: bytes, size: int = 256) -> bytes:
    """Whole blocks in an order that the key gives; a last short block keeps its place, so that nothing is lost."""
    n = len(data) // size
    return b"".join(data[i * size : (i + 1) * size] for i in _order(n, key)) + data[n * size :]


def unshuffle_blocks(data: bytes, key: bytes, size: int = 256) -> bytes:
    n = len(data) // size
    out = [b""] * n
    for place, i in enumerate(_order(n, key)):
        out[i] = data[place * size : (place + 1) * size]
    return b"".join(out) + data[n * size :]


def vault_size(keys: Column) -> Column:
    """Bytes of a vault of so many keys."""
    return F.when(keys > 0, 28 + 64 * keys).otherwise(0)


def commitment(*fields: Column) -> Column:
    """Hash over fields that may not change; mutable ones are left out by the caller."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


_PARTS = {"wraps": "type int, body binary", "variants": "name string, type int, offset long, size long", "refs": "hash binary, kind int"}
WRAP_SET = T.StructType([T.StructField(name, T.ArrayType(table_of(columns))) for name, columns in _PARTS.items()])


def _each(values: pd.Series, read) -> pd.Series:
    """read of each value; null for null and for what read refuses."""

    def one(x):
        try:
            return None if x is None else read(bytes(x))
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(WRAP_SET)
def wrap_sets(values: pd.Series) -> pd.DataFrame:
    """Wraps, variants and references of serialised wrap sets."""
    found = [read_wraps(bytes(x)) if x is not None else dict.fromkeys(("wraps", "variants", "refs")) for x in values]
    names = {part: table_of(columns).names for part, columns in _PARTS.items()}
    return pd.DataFrame({part: [None if r[part] is None else [dict(zip(fields, x, strict=True)) for x in r[part]] for r in found] for part, fields in names.items()})


@F.pandas_udf(table_of("epoch long, window long, uses int, claims binary"))
def tokens(values: pd.Series) -> pd.DataFrame:
    """Fields of tokens; all null for what is none."""
    found = _each(values, read_token)
    return pd.DataFrame([x or (None,) * 4 for x in found], columns=["epoch", "window", "uses", "claims"]).astype({"epoch": "Int64", "window": "Int64", "uses": "Int32"})


@F.pandas_udf(T.BinaryType())
def token_of(epochs: pd.Series, windows: pd.Series, uses: pd.Series, claims: pd.Series) -> pd.Series:
    return pd.Series([write_token(int(e), int(w), int(u), bytes(c or b"")) for e, w, u, c in zip(epochs, windows, uses, claims, strict=True)])


@F.pandas_udf(T.StringType())
def one_time_codes(secrets: pd.Series, seconds: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else one_time_code(bytes(s), int(at)) for s, at in zip(secrets, seconds, strict=True)])


@F.pandas_udf(T.BooleanType())
def codes_fit(secrets: pd.Series, codes: pd.Series, seconds: pd.Series) -> pd.Series:
    return pd.Series([s is not None and c is not None and code_fits(bytes(s), c, int(at)) for s, c, at in zip(secrets, codes, seconds, strict=True)])


@F.pandas_udf(T.BinaryType())
def shuffled(payloads: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else shuffle_blocks(bytes(x), bytes(k)) for x, k in zip(payloads, keys, strict=True)])


@F.pandas_udf(T.BinaryType())
def unshuffled(payloads: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unshuffle_blocks(bytes(x), bytes(k)) for x, k in zip(payloads, keys, strict=True)])
