"""Content ids, keyed ids and Merkle hashes as column expressions, and the key hierarchy.

SHA-256 takes the place of BLAKE3, scrypt that of Argon2id, and AES-GCM that of XChaCha20-Poly1305: none of these is
in Spark or the standard library. Every place where that matters says so.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the key hierarchy.
CHUNK_KEY_INFO, METADATA_KEY_INFO, KEY_BYTES, LEAST_SALT = b"backup-chunk-hmac-v1", b"backup-metadata-v1", 32, 16
_BLOCK = 64


def master_key(passphrase: str, salt: bytes) -> bytes:
    """32 bytes from a passphrase; the salt has 16 bytes at least."""
    if len(salt) < LEAST_SALT:
        raise ValueError(f"the salt needs {LEAST_SALT} bytes at least, not {len(salt)}")
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=2**14, r=8, p=1, dklen=KEY_BYTES)


def subkey(master: bytes, info: bytes) -> bytes:
    """HKDF-Expand to 32 bytes, which is one block of SHA-256."""
    return hmac.new(master, info + b"\x01", hashlib.sha256).digest()


def subkeys(passphrase: str, salt: bytes) -> tuple[bytes, bytes]:
    """(key of chunk keys, key of storage ids and metadata)."""
    master = master_key(passphrase, salt)
    return subkey(master, CHUNK_KEY_INFO), subkey(master, METADATA_KEY_INFO)


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def sha256(value: Column) -> Column:
    """SHA-256 as binary."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def content_id(content: Column) -> Column:
    """The id of a content, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def pads(key: bytes) -> tuple[bytes, bytes]:
    key = key if len(key) <= _BLOCK else hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column under one key, as binary."""
    inner, outer = pads(key)
    return sha256(F.concat(binary(outer), sha256(F.concat(binary(inner), message))))


def chunk_key(key_data: bytes, cid: Column) -> Column:
    """The encryption key of a content id (hex), as binary."""
    return hmac_sha256(key_data, F.unhex(cid))


def storage_id(key_meta: bytes, cid: Column) -> Column:
    """The storage id of a content id (hex), as hex: equal contents have equal ids under one key and unrelated ones under another."""
    return F.lower(F.hex(sha256(hmac_sha256(key_meta, F.unhex(cid)))))


def little_endian(value: Column, size: int) -> Column:
    """An integer's low `size` bytes, lowest first."""
    digits = F.lpad(F.right(F.hex(value.cast("bigint")), F.lit(2 * size)), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * size - 1 - 2 * i, 2) for i in range(size))))


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.right(F.hex(value.cast("bigint")), F.lit(2 * size)), 2 * size, "0"))


def from_big_endian(value: Column) -> Column:
    """A binary column of 8 bytes at most as a bigint."""
    return F.conv(F.hex(value), 16, 10).cast("decimal(20,0)").cast("bigint")


def joined_binary(values: Column) -> Column:
    """The binaries of an array one after another; empty for an empty array."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.hex(v)), ""))


def merkle_file_hash(path, storage_ids, content_hash, mode, mtime_epoch, uid, gid, symlink_target=None, xattrs=None) -> Column:
    """Hash of a file node, hex. storage_ids is an array of hex in order, content_hash hex, xattrs array<struct<name,value>>.

    The size takes no part and fields are not framed, as the data model has it.
    """
    parts = [
        path.cast("binary"), F.unhex(F.array_join(storage_ids, "")), F.unhex(content_hash), little_endian(mode, 4), little_endian(mtime_epoch, 8),
        little_endian(uid, 4), little_endian(gid, 4), F.coalesce(symlink_target if symlink_target is not None else F.lit(""), F.lit("")).cast("binary"),
    ]
    if xattrs is not None:
        each = F.transform(xattrs, lambda x: F.concat(x["name"].cast("binary"), x["value"]))
        parts.append(F.coalesce(joined_binary(each), binary(b"")))
    return F.sha2(F.concat(*parts), 256)


def merkle_dir_hash(path, subdir_hashes, file_hashes) -> Column:
    """Hash of a directory from its children's hashes (arrays of hex, each in list order)."""
    return F.sha2(F.concat(path.cast("binary"), F.unhex(F.array_join(F.concat(subdir_hashes, file_hashes), ""))), 256)


def seal(content: Column, key: Column, aad: Column) -> Column:
    """AES-GCM under a per-row key with a nonce made of key and content, as convergent encryption needs it; nonce first."""
    nonce = F.substring(sha256(F.concat(key, content)), 1, 12)
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)


def open_sealed(sealed: Column, key: Column, aad: Column) -> Column:
    """The content, or null where key or aad do not fit or a byte was changed."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def encrypt_metadata(content: Column, key: bytes) -> Column:
    """AES-GCM with a random nonce and no further data."""
    return F.aes_encrypt(content, binary(key), F.lit("GCM"))


def decrypt_metadata(sealed: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(sealed, binary(key), F.lit("GCM"))
