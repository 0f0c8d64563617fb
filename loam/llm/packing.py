"""Best-fit packing of token sequences, certified by lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm.shared import stored

PIECE = "row long, {id} {kind}, piece int, start long, length long, ids_crc32 long"
LONG = 512
# Fixed value: how a byte-level BPE of this kind cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The file's vocabulary, read as ranks, gives the same ids with tiktoken in a third of
    the time. Texts that hold a special token's string, or a run of over `LONG` characters
    without white space (which tiktoken merges in quadratic time), go to the tokenizers
    library itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A vocabulary entry writes each byte as one character: printable ones as themselves, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in self.tokenizer.get_vocab().items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.special) or max(map(len, text.split()), default=0) > LONG:
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, room: int, last: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: row, id, piece, start, length, ids_crc32. `row` tells repeated rows apart."""
    end = np.array([last], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for i, text in enumerate(part.column(2).to_pylist()):
                    ids = coder.ids(text or "") + end
                    n = len(ids) // 4
                    first = n if n <= room else n % room or room
                    starts = [0, *range(first, n, room)]
                    out += [(i, k, s, e - s, zlib.crc32(ids[4 * s:4 * e])) for k, (s, e) in enumerate(zip(starts, [*starts[1:], n]))]
                i, k, s, length, crc = (list(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(s, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["row", id_col, "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col).alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(cut, PIECE.format(id=f"`{id_col}`", kind=kind))


def lower_bound(counts: np.ndarray) -> int:
    """Fewest bins that items can need; counts[n] items have length n, a bin holds len(counts) - 1.

    The best of two families of dual-feasible functions, with every parameter: lengths
    over room - k count in full and those under k not at all (k = 0 is the plain sum), and
    lengths rounded down to steps of room / (k + 1), rescaled.
    """
    room = len(counts) - 1
    x = np.arange(room + 1)
    best = 0
    for k in range(room // 2 + 1):
        best = max(best, -(-int(counts[x > room - k].sum() * room + (counts * x)[(x >= k) & (x <= room - k)].sum()) // room))
    for k in range(1, 101):
        # in units of 1 / (room * k): exact whole numbers
        exact = (k + 1) * x % room == 0
        value = np.where(exact, x * k, (k + 1) * x // room * room)
        best = max(best, -(-int((counts * value).sum()) // (room * k)))
    return best


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item by best-fit decreasing, and the free room of each bin."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    some, free = 0, []  # bit f of `some`: a bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = by_free[left].pop()
            if not by_free[left]:
                some &= ~(1 << left)
        else:
            b, left = len(free), room
            free.append(room)
        bins[i], offsets[i] = b, room - left
        free[b] = left - need
        if left > need:
            by_free[left - need].append(b)
            some |= 1 << left - need
    return bins, offsets, free


def pack(docs: DataFrame, tokenizer_path: str, room: int = 1024, last: int = 2, id_col: str = "doc_id", text_col: str = "text",
         per_task: int = 20_000, rounds: int = 3, loosest: float = 0.1) -> DataFrame:
    """Documents as token pieces in sequences of at most `room` tokens, as few as it can.

    (id, piece, start, length, ids_crc32, sequence_id, offset). A document is its ids and
    then `last`; only one longer than `room` is cut, all pieces but the first being full.
    Full pieces are sequences of their own. The others are dealt by hash into groups of
    about `per_task`, each packed by best-fit decreasing and held against a lower bound
    from dual-feasible functions. A group that meets its bound is certified and final; one
    with a gap gives the documents of its loosest bins to the next round, where those of
    all such groups are dealt anew and packed again. After the last round all is final.

    Null text is empty: one piece with only `last`. Repeated rows are packed each; empty
    input gives no rows; other columns are ignored. Token ids stay in the task that made
    them; pieces are written to the shared folder before they are packed.
    """
    cut = stored(pieces(docs, tokenizer_path, room, last, id_col, text_col), "pieces")
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    done = cut.where(F.col("length") == room).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kind = cut.schema[id_col].dataType.simpleString()
    schema = f"row long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean"
    todo = cut.where(F.col("length") < room)
    for turn in range(rounds):
        count = todo.count()
        if not count:
            break
        groups = -(-count // per_task)

        def packed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["row", "piece"], ignore_index=True)
            lengths = group["length"].to_numpy()
            bins, offsets, free = best_fit(lengths, room)
            gap = len(free) - lower_bound(np.bincount(lengths, minlength=room + 1))
            final = np.ones(len(free), dtype=bool)
            if gap > 0 and turn < rounds - 1:
                final[np.argsort(-np.array(free), kind="stable")[:max(gap + 1, int(loosest * len(free)))]] = False
            number = (turn << 56) + (int(group["part"].iloc[0]) << 24) + bins
            return group.drop(columns="part").assign(sequence_id=number, offset=offsets, final=final[bins])

        part = F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(groups))
        out = stored(todo.withColumn("part", part).groupBy("part").applyInPandas(packed, schema), "packed")
        done = done.union(out.where("final").select(*done.columns))
        todo = out.where("not final").select(*cut.columns)
    return done
