"""Keyed protection of vectors, names and texts."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import let, normalized, quantize_int16

# Share of the noise radius by scheme and side.
SHARES = {("distance", "document"): 3 / 8, ("distance", "query"): 1 / 8, ("simple", "document"): 1 / 4, ("simple", "query"): 1 / 4}


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC of a binary column with a key known to the driver."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.lit(bytes(b ^ x for b in block.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def pseudonym(name: Column, label: str, key: bytes) -> Column:
    """Keyed name; another label gives another pseudonym."""
    return hmac_sha256(key, F.concat(F.lit(f"{label}\0".encode()), name.cast("binary")))


def encrypted(text: Column, key: bytes, row_id: Column | None = None) -> Column:
    """AES-GCM with a random nonce, or one made of the row's id."""
    if row_id is None:
        return F.aes_encrypt(text, F.lit(key), F.lit("GCM"))
    nonce = F.substring(F.unhex(F.sha2(row_id, 256)), 1, 12)
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)


def decrypted(sealed: Column, key: bytes, strict: bool = True) -> Column:
    """The text again; a wrong key or a changed byte is an error, or null if not ``strict``."""
    open_ = F.aes_decrypt if strict else F.try_aes_decrypt
    return open_(sealed, F.lit(key), F.lit("GCM")).cast("string")


def keyed_numbers(tag: Column, count: Column) -> Column:
    """``count`` unsigned 32-bit numbers as doubles: SHA-256 of the bytes of ``tag`` (hexadecimal) and a 32-bit counter, read in little-endian fours."""

    def block(n: Column) -> Column:
        le = F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0") for k in range(4)])
        number = lambda h, j: F.conv(F.concat(*[F.substring(h, 8 * j + 1 + 2 * k, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("double")
        return let(F.sha2(F.unhex(F.concat(tag, le)), 256), lambda h: F.array(*[number(h, j) for j in range(8)]))

    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(count / 8).cast("int") - 1, F.lit(0))), block))
    return F.slice(blocks, F.lit(1), count)


def _noise(vector: Column, tag: Column, radius: float) -> Column:
    """A direction uniform on the sphere, of length at most ``radius`` and uniform in the ball, for each tag: normal numbers in pairs of hashes."""
    size = F.size(vector)
    share = lambda n: (n + 0.5) / 2.0**32

    def moved(numbers: Column) -> Column:
        place = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
        normal = F.transform(place, lambda i: F.sqrt(-2 * F.log(share(F.get(numbers, 2 * i)))) * F.cos(2 * math.pi * share(F.get(numbers, 2 * i + 1))))
        length = radius * F.pow(share(F.get(numbers, 2 * size)), 1 / size)
        return let(normalized(normal), lambda u: let(length, lambda r: F.transform(u, lambda x: x * r)))

    return let(keyed_numbers(tag, 2 * size + 1), moved)


def _apply(rows: DataFrame, vector: str, key: bytes, side: str, scheme: str, scale: float, beta: float, back: bool) -> DataFrame:
    tag = hmac_sha256(key, F.concat(F.lit(f"noise|{side}|".encode()), F.col("nonce")))
    v = F.col(vector).cast("array<double>")
    noise = _noise(v, tag, SHARES[scheme, side] * scale * beta)
    change = (lambda x, e: (x - e) / scale) if back else (lambda x, e: x * scale + e)
    return rows.withColumn(vector, F.when(F.size(v) > 0, let(noise, lambda n: F.zip_with(v, n, change))).otherwise(v))


def protect(rows: DataFrame, row_id: str | None, vector: str, key: bytes, side: str, scheme: str = "distance", scale: float = 32.0, beta: float = 0.15) -> DataFrame:
    """``vector`` scaled and moved in a keyed direction by at most share * scale * beta; ``nonce`` and ``scheme`` are added.

    ``side`` is document or query.  The nonce is random if ``row_id`` is None.  Made of an id instead, a row is
    protected alike on every run, but two vectors of one id get the same noise, which their difference
    removes: only for ids that never come again with another vector.
    """
    if row_id is None:
        source = F.concat(F.lit(b"random|"), F.uuid().cast("binary"))
    else:
        source = F.concat(F.lit(b"nonce|"), F.col(row_id).cast("string").cast("binary"))
    ready = rows.withColumns({"nonce": F.substring(F.unhex(hmac_sha256(key, source)), 1, 16), "scheme": F.lit(f"{scheme}/{side}")})
    return _apply(ready, vector, key, side, scheme, scale, beta, back=False)


def unprotect(rows: DataFrame, vector: str, key: bytes, side: str, scheme: str = "distance", scale: float = 32.0, beta: float = 0.15) -> DataFrame:
    """Vectors before :func:`protect`; rows of another scheme or side are an error."""
    name = f"{scheme}/{side}"
    same = rows.withColumn("scheme", F.when(F.col("scheme") == name, F.col("scheme")).otherwise(F.raise_error(F.concat(F.lit(f"not {name}: "), F.col("scheme"))).cast("string")))
    return _apply(same.where("scheme is not null"), vector, key, side, scheme, scale, beta, back=True)


def int16_bytes(vector: Column) -> Column:
    """The quantised vector as little-endian signed 16-bit integers."""
    swapped = lambda c: c.bitwiseAND(F.lit(255)) * 256 + F.shiftright(c, 8).bitwiseAND(F.lit(255)) + 65536
    return F.unhex(F.array_join(F.transform(quantize_int16(vector), lambda c: F.substring(F.hex(swapped(c).cast("long")), 2, 4)), ""))


def session_perturbed(rows: DataFrame, vector: str, session: bytes, kind: str, eps: float = 0.02) -> DataFrame:
    """``vector`` moved by ``eps`` in a direction keyed by session, kind and the quantised vector, of unit length.

    The same within a session and kind, different across them.  The direction is a hash's numbers, mapped to
    -1 to 1 and normalised.
    """
    v = F.col(vector).cast("array<double>")
    tag = hmac_sha256(session, F.concat(F.lit(kind.encode() + b"\0"), int16_bytes(v)))
    direction = lambda t: normalized(F.transform(keyed_numbers(t, F.size(v)), lambda n: n / float(2**32 - 1) * 2 - 1))
    moved = let(tag, lambda t: let(direction(t), lambda u: normalized(F.zip_with(v, u, lambda x, d: x + eps * d))))
    return rows.withColumn(vector, F.when(F.size(v) > 0, moved).otherwise(v))
