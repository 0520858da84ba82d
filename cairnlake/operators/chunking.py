"""Chunking: lines in plain column expressions, content-defined chunks with vectorised gear hashing."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_id

#: Fixed values of the gear table: 256 words of a linear congruential generator.
GEAR_SEED, GEAR_FACTOR, GEAR_ADD = 0x12345678, 1664525, 1013904223


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in bytes, and the masks before and after the target size."""

    least: int = 256 * 1024
    target: int = 1024 * 1024
    most: int = 4 * 1024 * 1024
    strict: int = 0x001FFFFF
    normal: int = 0x0007FFFF


#: For short texts: 256 bytes, 1 KiB, 4 KiB.
SMALL = Sizes(256, 1024, 4096, 0x7FF, 0x1FF)


def gear_table() -> np.ndarray:
    out, state = np.zeros(256, np.uint32), GEAR_SEED
    for i in range(256):
        state = (state * GEAR_FACTOR + GEAR_ADD) % 2**32
        out[i] = state
    return out


_GEAR = gear_table()
_GEAR_LIST = _GEAR.tolist()


#: Fingerprints are made of so many bytes at a time, so that their arrays stay in a core's cache.
BLOCK = 1 << 15


def _rolling(gear: np.ndarray) -> np.ndarray:
    """At every byte the fingerprint of the 32 bytes up to it: older ones have left a 32-bit word. Windows double in five steps."""
    h, shifted, width = gear, np.empty_like(gear), 1
    while width < min(32, len(h)):
        np.left_shift(h[:-width], np.uint32(width), out=shifted[width:])
        h[width:] += shifted[width:]
        width *= 2
    return h


def _candidates(data: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The places at which the strict and the normal mask find nothing set."""
    found = [], []
    for start in range(0, len(data), BLOCK):
        lead = min(31, start)
        h = _rolling(_GEAR[data[start - lead : start + BLOCK]])[lead:]
        either = np.flatnonzero((h & np.uint32(sizes.strict & sizes.normal)) == 0)
        for out, mask in zip(found, (sizes.strict, sizes.normal)):
            out.append(start + either[(h[either] & np.uint32(mask)) == 0])
    return np.concatenate(found[0]), np.concatenate(found[1])


def cut_points(data: bytes, sizes: Sizes = Sizes()) -> list[int]:
    """Ends of the chunks of data. A chunk's fingerprint starts at 0 after its least size, so its first 31 bytes there see a shorter window."""
    n = len(data)
    if not n:
        return []
    ends, start, gear = [], 0, _GEAR_LIST
    if n > sizes.least:
        strict, normal = _candidates(np.frombuffer(data, np.uint8), sizes)
    while n - start > sizes.least:
        low, middle, high = (min(n, start + x) for x in (sizes.least, sizes.target, sizes.most))
        end, fresh, warm = high, 0, min(low + 31, high)
        for i in range(low, warm):
            fresh = ((fresh << 1) + gear[data[i]]) & 0xFFFFFFFF
            if not fresh & (sizes.strict if i < middle else sizes.normal):
                end = i
                break
        else:
            for hits, a, b in ((strict, warm, middle), (normal, max(warm, middle), high)):
                k = np.searchsorted(hits, a)
                if a < b and k < len(hits) and hits[k] < b:
                    end = int(hits[k])
                    break
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fastcdc(files: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of files (path, content binary): path, ordinal, offset, length, cid. Empty files have none."""

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, data in enumerate(batch.column("content").to_pylist()):
                start = 0
                for i, end in enumerate(cut_points(data or b"", sizes)):
                    at.append(k)
                    rows.append((i, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            own = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(at, pa.int64())), *own], ["path", "ordinal", "offset", "length", "cid"])

    kind = dict(files.dtypes)["path"]
    return files.select("path", "content").mapInArrow(run, f"path {kind}, ordinal int, offset bigint, length bigint, cid string")


def line_chunks(files: DataFrame, text: str = "text") -> DataFrame:
    """Lines as chunks, without their line feeds: all other columns, ordinal, chunk, length (bytes), cid."""
    keys = [c for c in files.columns if c != text]
    rows = files.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("ordinal", "chunk"))
    return rows.withColumns({"length": F.octet_length("chunk").cast("bigint"), "cid": content_id(F.col("chunk"))})


def line_slices(files: DataFrame) -> DataFrame:
    """Lines as chunks of files (path, content binary), with their line feeds: path, ordinal, offset, length, cid. Empty files have none."""
    rows = files.select("path", F.split(F.decode("content", "utf-8"), "\n", -1).alias("lines")).select("path", F.posexplode("lines").alias("ordinal", "s"), (F.size("lines") - 1).alias("last"))
    chunk = F.when(F.col("ordinal") < F.col("last"), F.concat("s", F.lit("\n"))).otherwise(F.col("s"))
    rows = rows.select("path", "ordinal", F.octet_length(chunk).cast("bigint").alias("length"), content_id(chunk).alias("cid")).filter("length > 0")
    return chunk_offsets(rows, ["path"]).select("path", "ordinal", "offset", "length", "cid")


def chunk_offsets(chunks: DataFrame, file: list[str], separator: int = 0) -> DataFrame:
    """Adds offset: where a chunk begins in its file, from the lengths before it (and a separator after each)."""
    w = Window.partitionBy(*file).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(F.col("length") + separator).over(w), F.lit(0)).cast("bigint"))
