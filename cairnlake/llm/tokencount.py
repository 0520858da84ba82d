"""Token counts by a compiled finite-state transducer (see transducer.py).

Texts are cut into chunks of bytes anywhere. A chunk's state map takes the state in which the chunk is
entered to the state in which it is left, and the count made meanwhile. At a blank, and where letters, digits and marks of ASCII meet, every state
goes to the start, so past a chunk's first such place all entries run together, and the exit state hangs on what follows the last one alone. The map is
thus held as the bytes before the first place (on which the entry state bears), the count between the first and the last place, and the bytes
after the last one (which make the exit state). Maps compose associatively; those of a text's chunks by a tree of bounded fan-in, level by
level. A text of one chunk is entered in the start state, and its map closed at once.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .transducer import TokenCounter, token_counter

CHUNK, LIMIT, FAN_IN = 1 << 20, 2048, 256
BLANKS = b" \t\n\r\x0b\x0c"
#: Places between two bytes at which a pre-token is certain to end, whatever stands around: not beside `'` on its right, and not beside
#: the bytes that added tokens are made of.
_MARKS = rb"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
_BORDER = re.compile(rb"(?<=[A-Za-z])(?=[0-9'%b])|(?<=[0-9])(?=[A-Za-z0-9'%b])|(?<=[%b])(?=[A-Za-z0-9])" % (_MARKS, _MARKS, _MARKS))

#: A state map: (bytes before the first border, count between, bytes after the last border), or (bytes, None, b"") without any.
StateMap = tuple[bytes, int | None, bytes]


def _opened(counter: TokenCounter, word: bytes) -> StateMap:
    """The map of a word."""
    borders = [m.start() for m in _BORDER.finditer(word)]
    return (word[: borders[0]], counter.count(word[borders[0] : borders[-1]]), word[borders[-1] :]) if borders else (word, None, b"")


def chunk_map(counter: TokenCounter, chunk: bytes) -> StateMap:
    if not chunk:
        return b"", None, b""
    words = chunk.split()
    head = tail = (b"", 0, b"")
    if words and chunk[0] not in BLANKS:
        head = _opened(counter, words.pop(0))
        if not words and chunk[-1] not in BLANKS:
            return head
    if words and chunk[-1] not in BLANKS:
        tail = _opened(counter, words.pop())
    middle = sum(map(counter.__getitem__, words))
    if head[1] is not None:  # a blank ends what follows the first word's last border
        middle += head[1] + counter.count(head[2])
    if tail[1] is not None:
        middle += counter.count(tail[0]) + tail[1]
    return head[0], middle, tail[0] if tail[1] is None else tail[2]


def compose(counter: TokenCounter, a: StateMap, b: StateMap) -> StateMap:
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    if b[1] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + counter.count(a[2] + b[0]) + b[1], b[2]


def composed(counter: TokenCounter, maps: list[StateMap]) -> StateMap:
    """One map of several in order; neighbours compose pair by pair, as in a parallel prefix scan's up-sweep."""
    while len(maps) > 1:
        maps = [compose(counter, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def closed(counter: TokenCounter, m: StateMap) -> int:
    """The count of a whole text from its map: entered in the start state, ended after the last byte."""
    return counter.count(m[0]) + (m[1] or 0) + counter.count(m[2])


def compose_all(counter: TokenCounter, maps: list[StateMap]) -> int:
    return closed(counter, composed(counter, maps))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), for every row of docs.

    tokenizer is the file's path. Null and empty texts have 0 tokens. Rows that repeat a doc_id, or have none,
    count each. Other columns are not read. No rows give no rows.
    """
    work = Workspace(docs.sparkSession, "tokencount")
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(text_or_empty(), "utf-8").alias("b"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("n_bytes", F.octet_length("b").cast("long")).withColumn("parts", F.greatest(F.ceil(F.col("n_bytes") / chunk), F.lit(1)).cast("long"))
    rows = rows.withColumn("i", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["row", "doc_id", "n_bytes", "parts", "i"]
    schema = "row long, doc_id long, n_bytes long, parts long, i long, head binary, middle long, tail binary, n_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]

    def mapped(batches):
        counter = token_counter(tokenizer)
        for batch in batches:
            single = [p == 1 for p in batch.column("parts").to_pylist()]
            out = []
            for start in range(0, batch.num_rows, 200):
                for one, b in zip(single[start:], batch.column("b").slice(start, 200).to_pylist()):
                    m = (b"", sum(map(counter.__getitem__, b.split())), b"") if one else chunk_map(counter, b)
                    out.append((None, None, None, m[1]) if one else (*m, None))
            own = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *own], names)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        counter = token_counter(tokenizer)
        pdf = pdf.sort_values("i")
        maps = [(bytes(h), None if pd.isna(m) else int(m), bytes(t)) for h, m, t in zip(pdf["head"], pdf["middle"], pdf["tail"])]
        m, first = composed(counter, maps), pdf.iloc[0]
        parts = -(-int(first["parts"]) // fan_in)
        whole = closed(counter, m) if parts == 1 else None
        doc_id = None if pd.isna(first["doc_id"]) else int(first["doc_id"])
        out = pd.DataFrame([(int(first["row"]), doc_id, int(first["n_bytes"]), parts, int(first["i"]) // fan_in, *m, whole)], columns=names)
        return out.astype({"doc_id": "Int64", "middle": "Int64", "n_tokens": "Int64"})

    level = work.write(rows.select(*keys, F.substring(F.col("b"), F.col("i") * chunk + 1, F.lit(chunk)).alias("b")).mapInArrow(mapped, schema), "level0")
    done, k = [level.filter("parts = 1")], 0
    while not (open_ := level.filter("parts > 1")).isEmpty():
        k += 1
        level = work.write(open_.groupBy("row", F.floor(F.col("i") / fan_in)).applyInPandas(merged, schema), f"level{k}")
        done.append(level.filter("parts = 1"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
