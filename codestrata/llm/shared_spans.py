"""Problem 5: long exact spans shared between records.

Method: difference-cover anchors. A cover D of the residues modulo v holds, for
any two offsets, a common shift below v that takes both into D; so two places
that agree on ``w + v - 1`` characters share a window of ``w`` at positions
both in the cover. Only those windows are hashed (|D| / v of all). Windows that
recur under another record are anchors; an anchor then extends: the stretches
of the wanted length around it are hashed twice over and compared, and the
characters of those that recur under another record are shared.

Places are compared by hash groups and never pair by pair. Hashes travel as
packed blocks by hash range, and a batch sends each hash once however many of
its records hold it, so text that a third of all records share costs a group
no more rows than there are batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.scratch import Scratch
from codestrata.session import ship, spread

# Perfect difference sets modulo v, every non-zero residue is a difference just once.
COVERS = {
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [1, 5, 11, 24, 25, 27],
    57: [0, 1, 6, 15, 22, 26, 45, 55],
    91: [0, 1, 3, 9, 27, 49, 56, 61, 77, 81],
    133: [1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121],
}

#: Characters of text that a task hashes at a time.
BATCH_CHARS = 4_000_000
#: Hash ranges: at least so many, and so many for each partition of the texts, so that a range, which one
#: comparison holds in memory, does not grow with the data.
SHARD_BITS, LEAST_SHARDS, SHARDS_A_PART = 24, 256, 16

_BASE = 0x9E3779B97F4A7C15 | 1
#: Prime moduli below 2**31 and a base of each, for the second hash.
_PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_566_083_941))
_PACKED = "shard int, hash binary, check binary, rec binary, pos binary"


def cover_for(length: int) -> tuple[int, np.ndarray, int]:
    """(period, cover, window) for matches of ``length``: the largest period that leaves half of it as window, or any."""
    fit = [v for v in COVERS if v <= max(7, (length + 1) * 2 // 3)]
    v = max(fit)
    return v, np.array(sorted(x % v for x in COVERS[v])), max(1, length - v + 1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def _powers_modulo(base: int, n: int, prime: int) -> np.ndarray:
    p = np.ones(max(n, 1), np.uint64)
    known = 1
    while known < n:  # twice as many by one product
        more = min(known, n - known)
        p[known : known + more] = p[:more] * np.uint64(pow(base, known, prime)) % np.uint64(prime)
        known += more
    return p[:n]


class Hasher:
    """Window hashes of many texts laid end to end, by prefix sums.

    The first hash works modulo 2**64. Some texts of regular make collide there
    whatever the base, so the second works modulo two primes.
    """

    def __init__(self) -> None:
        self.n = 0

    def _grow(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = max(n, 2 * self.n)
        self.pow, self.inv = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 2**64), self.n)
        self.prime_pow = [_powers_modulo(b, self.n, p) for p, b in _PRIMES]
        self.prime_inv = [_powers_modulo(pow(b, -1, p), self.n, p) for p, b in _PRIMES]

    def fast(self, codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        self._grow(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(0x51ED27)) * self.pow[: len(codes)], out=sums[1:])
        h = (sums[starts + width] - sums[starts]) * self.inv[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))

    def sound(self, codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        self._grow(len(codes))
        out = np.zeros(len(starts), np.uint64)
        for (prime, _), power, inverse in zip(_PRIMES, self.prime_pow, self.prime_inv):
            p = np.uint64(prime)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * power[: len(codes)] % p, out=sums[1:])  # fits: 2**31 for each of BATCH_CHARS and one text more
            out = (out << np.uint64(31)) | ((sums[starts + width] - sums[starts]) % p * inverse[starts] % p)
        return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters end to end, and the start and length of each text."""
    whole = "".join(texts).encode("utf-32-le", "surrogatepass")
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(whole, np.uint32).astype(np.uint64), np.cumsum(length) - length, length


def _pack(h: np.ndarray, check: np.ndarray | None, rec: np.ndarray, pos: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows of one hash range each. Equal hashes of two records of this batch are known shared: range -1."""
    order = np.lexsort((rec, h)) if check is None else np.lexsort((rec, check, h))
    h, rec, pos = h[order], rec[order], pos[order]
    check = check[order] if check is not None else None
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if check is not None:
        new[1:] |= check[1:] != check[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(first[1:], len(h)) - 1
    known = (rec[first] != rec[last])[group] if len(h) else np.zeros(0, bool)
    send = new | ~known  # of a known group one place goes on, so that other batches hear of it
    shard = (h >> np.uint64(64 - SHARD_BITS)).astype(np.int64) * shards >> SHARD_BITS
    cols: list[list] = [[], [], [], [], []]

    def row(s: int, i: np.ndarray) -> None:
        cols[0].append(s)
        cols[1].append(h[i].tobytes())
        cols[2].append(check[i].tobytes() if check is not None else b"")
        cols[3].append(rec[i].tobytes())
        cols[4].append(pos[i].astype(np.int32).tobytes())

    sent = np.flatnonzero(send)
    used, first_of = np.unique(shard[sent], return_index=True)
    for s, a, b in zip(used.tolist(), first_of, np.append(first_of[1:], len(sent))):
        row(s, sent[a:b])
    told = np.flatnonzero(known)
    for at in range(0, len(told), 65_536):
        row(-1, told[at : at + 65_536])
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "hash", "check", "rec", "pos"])


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], list]]:
    """Record ids and texts (and the third column, if any) of about BATCH_CHARS at a time."""
    ids, texts, extra, n = [], [], [], 0
    for batch in batches:
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for i, t, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), more):
            ids.append(i)
            texts.append(t)
            extra.append(e)
            n += len(t)
            if n >= BATCH_CHARS:
                yield np.array(ids, np.int64), texts, extra
                ids, texts, extra, n = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, extra


def _anchors(length: int, shards: int):
    v, cover, w = cover_for(length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for ids, texts, _ in _batched(batches):
            codes, start, size = _codes(texts)
            most = int(size.max(initial=0))
            grid = (np.arange(most // v + 1)[:, None] * v + cover[None, :]).ravel()
            n = np.searchsorted(grid, size - w, side="right")
            own = np.repeat(np.arange(len(texts)), n)
            pos = grid[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
            h = hasher.fast(codes, start[own] + pos, w)
            yield _pack(h, None, ids[own], pos, shards)

    return anchors


def _stretches(length: int, shards: int):
    w = cover_for(length)[2]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for ids, texts, found in _batched(batches):
            codes, start, size = _codes(texts)
            own, pos = [], []
            for k, at in enumerate(found):
                if size[k] < length:
                    continue
                mark = np.zeros(size[k] + 2, np.int32)
                a = np.asarray(at, np.int64)
                np.add.at(mark, np.clip(a + w - length, 0, size[k] - length + 1), 1)
                np.add.at(mark, np.clip(a + 1, 0, size[k] - length + 1), -1)
                p = np.flatnonzero(np.cumsum(mark[: size[k] - length + 1]) > 0)
                own.append(np.full(len(p), k))
                pos.append(p)
            if not own:
                continue
            own, pos = np.concatenate(own), np.concatenate(pos)
            at = start[own] + pos
            yield _pack(hasher.fast(codes, at, length), hasher.sound(codes, at, length), ids[own], pos, shards)

    return stretches


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec, pos) of the places whose hash another record has too; rows come sorted by range."""
    held: list[tuple] = []
    now = None

    def emit(rec: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(pos, pa.int32())], names=["rec", "pos"])

    def close() -> pa.RecordBatch:
        h, check, rec, pos = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.lexsort((rec, check, h)) if len(check) else np.lexsort((rec, h))
        h, rec, pos = h[order], rec[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if len(check):
            check = check[order]
            new[1:] |= check[1:] != check[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        shared = (rec[first] != rec[last])[np.cumsum(new) - 1]
        return emit(rec[shared], pos[shared])

    for batch in batches:
        for shard, h, check, rec, pos in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if shard != now and held:
                yield close()
                held = []
            now = shard
            rec_, pos_ = np.frombuffer(rec, np.int64), np.frombuffer(pos, np.int32)
            if shard < 0:
                yield emit(rec_, pos_)
            else:
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(check, np.uint64), rec_, pos_))
    if held:
        yield close()


def _compare(packed: DataFrame) -> DataFrame:
    spot = F.when(F.col("shard") < 0, F.xxhash64("rec", "pos")).otherwise(F.col("shard").cast("long"))
    spread_out = packed.repartition(spot).sortWithinPartitions("shard")
    return spread_out.mapInArrow(_recurring, "rec long, pos int")


def _runs(length: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for rec, at in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = np.unique(at.values.to_numpy(zero_copy_only=False))
                cut = np.flatnonzero(np.diff(p) > length)
                out[0] += [rec] * (len(cut) + 1)
                out[1] += p[np.concatenate([[0], cut + 1])].tolist()
                out[2] += (p[np.concatenate([cut, [len(p) - 1]])] + length).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["id", "span_start", "span_end"])

    return runs


def shared_spans(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", length: int = 200) -> DataFrame:
    """``(id, span_start, span_end)``: the longest runs of shared characters of each record.

    A character is shared if it lies in a stretch of at least ``length``
    characters that also stands in a record of another id. Offsets count
    Unicode characters from 0, end exclusive. Rows with a null id or text, and
    texts shorter than ``length``, have no spans; repeated rows count once (an
    id shares nothing with itself); an empty table gives no rows. Only the two
    named columns are read.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shared-spans")
    scan = df.select(F.col(id_col).cast("long").alias("rec"), F.col(text_col).alias("text")).where(F.col("rec").isNotNull() & (F.length("text") >= length))
    shards = min(1 << SHARD_BITS, max(LEAST_SHARDS, SHARDS_A_PART * scan.rdd.getNumPartitions()))
    texts = spread(scan)
    places = _compare(texts.mapInArrow(_anchors(length, shards), _PACKED)).groupBy("rec").agg(F.collect_set("pos").alias("at"))
    places = scratch.save(places)
    near = texts.join(places, "rec").select("rec", "text", "at")
    shared = _compare(near.mapInArrow(_stretches(length, shards), _PACKED)).groupBy("rec").agg(F.collect_set("pos").alias("at"))
    return shared.mapInArrow(_runs(length), "id long, span_start int, span_end int").distinct()


def shared_shares(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", length: int = 200) -> DataFrame:
    """``(id, spans, shared_chars, shared_share)`` for every id with a shared span."""
    spans = shared_spans(df, id_col, text_col, length)
    sizes = df.select(F.col(id_col).cast("long").alias("id"), F.length(text_col).alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    per = spans.groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    return per.join(sizes, "id").select("id", "spans", "shared_chars", F.round(F.col("shared_chars") / F.col("n"), 6).alias("shared_share"))
