"""Best-fit packing of token pieces into sequences by best-two-fit.

Texts become ids, only documents longer than a sequence are cut, and the pieces' facts (no ids) are written
once. Pieces that fill a sequence are sequences of their own. The others are dealt by a hash of their place into
groups of bounded size, so that any number of pieces packs in parallel. Within a group each sequence is filled
greedily, largest piece that fits first; then its smallest piece is exchanged for two unpacked ones if
these fit the gap that widens so more tightly. Groups see like mixes of lengths; only a group's last sequences
stay loose, and these pieces are packed anew together, in fewer groups, for as long as a round closes at least half of its pieces. Then, or
when one group holds them all, sequences are closed as they are. So rounds are few, and no task ever holds more than a group.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, text_or_empty
from .tokens import word_ids

#: Texts are encoded so many at a time.
SEQUENCE, END_ID, GROUP_PIECES, LOOSE, TEXTS = 4096, 1, 100_000, 0.98, 200
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, memory: int = 1) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and row (numbers the input's rows)."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * sequence

    def cut(batches):
        ids = word_ids(tokenizer, memory)
        for batch in batches:
            at, out = [], []
            for k, b in enumerate(_few_at_a_time(ids, batch.column("text"))):
                b += end
                here = range((len(b) + step - 1) // step)
                at += [k] * len(here)
                out += [(i, i * sequence, min(step, len(b) - i * step) // 4, zlib.crc32(b[i * step : (i + 1) * step])) for i in here]
            own = [pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            of, row = (batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays([of, *own, row], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return rows.mapInArrow(lean(cut, "words"), PIECE)


def _few_at_a_time(ids, texts):
    for start in range(0, len(texts), TEXTS):
        yield from ids.of_texts(texts.slice(start, TEXTS))


def best_two_fit(lengths: list[int], room: int = SEQUENCE) -> list[list[int]]:
    """Bins of positions in `lengths` (each at most `room`)."""
    at: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        at.setdefault(n, []).append(i)
    for stack in at.values():
        stack.reverse()
    mask = sum(1 << n for n in at)  # bit n: a piece of length n is unpacked

    def largest(most: int) -> int:
        return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal mask
        i = at[n].pop()
        if not at[n]:
            mask &= ~(1 << n)
        return i

    def put(n: int, i: int) -> None:
        nonlocal mask
        at[n].append(i)
        mask |= 1 << n

    bins = []
    while mask:
        own, gap = [], room
        while gap > 0 and (n := largest(gap)) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap > 0 and len(own) > 1:
            small, wide = own[-1][0], gap + own[-1][0]
            best, pair = small, None
            a = largest(wide - 1)
            while a > 0 and 2 * a > best:
                b = largest(min(a, wide - a))
                if b == a and len(at[a]) < 2:
                    b = largest(min(a - 1, wide - a))
                if b > 0 and best < a + b <= wide:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                a = largest(a - 1)
            if pair:
                put(*own.pop())
                own += [(n, take(n)) for n in pair]
        bins.append([i for _, i in own])
    return bins


def pack(parts: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, loose: float = LOOSE) -> DataFrame:
    """Adds sequence_id and offset to pieces. Groups are packed apart; of several groups' sequences those filled
    below `loose` are opened again and their pieces packed together, in fewer groups, in a further round."""
    work = Workspace(parts.sparkSession, "packing")
    parts = work.write(parts, "pieces")
    n = parts.filter(F.col("length") < sequence).count()
    # Numbers: whole pieces -1, -2, ... by their place; packed ones by round, task and bin.
    place = F.xxhash64("doc_id", "piece", "row")
    full = parts.filter(F.col("length") == sequence).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, done, turn = parts.filter(F.col("length") < sequence), [full], 0
    last = False
    while True:
        groups = max(1, math.ceil(n / group_pieces))
        last = last or groups == 1

        def fill(batches, turn=turn, last=last):
            pdf = pd.concat(list(batches) or [pd.DataFrame()])
            if not len(pdf):
                return
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            first = (turn << 56) | (TaskContext.get().partitionId() << 32)
            lengths = pdf["length"].tolist()
            number, offset = [None] * len(pdf), [0] * len(pdf)
            for k, own in enumerate(best_two_fit(lengths, sequence)):
                if not last and sum(lengths[i] for i in own) < loose * sequence:
                    continue
                at = 0
                for i in own:
                    number[i], offset[i] = first + k, at
                    at += lengths[i]
            pdf["sequence_id"], pdf["offset"] = pd.array(number, dtype="Int64"), offset
            yield pdf

        packed = open_.repartition(groups, place) if groups > 1 else open_.repartition(1)
        packed = work.write(packed.mapInPandas(fill, f"{PIECE}, sequence_id long, offset long"), f"turn{turn}")
        done.append(packed.filter(F.col("sequence_id").isNotNull()))
        open_ = packed.filter(F.col("sequence_id").isNull()).select(*parts.columns)
        m = 0 if last else open_.count()
        if not m:
            break
        last = 2 * m > n
        n, turn = m, turn + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("row")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, memory: int = 1, **parameters) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its text's ids (null and blank texts have none) and end_id; so every row of docs
    has a piece, rows that repeat a doc_id (or have none) each their own. Other columns are not read; no rows give no rows.
    memory: of words in a worker, as a multiple of the least; it bears on time only.
    """
    return pack(pieces(docs, tokenizer, sequence, end_id, memory), sequence, **parameters)
