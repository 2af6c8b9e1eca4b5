"""Packing of tokenised documents into sequences, after a Martello-Toth reduction.

Lengths are whole numbers up to the sequence length, so an instance is a table of how many pieces have
each length. The reduction and the best fit work on that table (at most as many rows as the sequence
length, however many documents there are) and give patterns with the number of sequences filled by each.
Spark then ranks the pieces of each length and deals them out to the patterns' places.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookwright.llm.common import map_texts, text_or_empty
from bookwright.session import materialise

#: Rows that one task ranks; a length with more of them is dealt over more tasks.
RANK_ROWS = 50_000

Pattern = tuple[int, ...]


class JsonEncoder:
    """Ids of a byte-level BPE tokenizer file, as its library gives them without special tokens.

    The file's ids are also the order of its merges, so its vocabulary serves as ranks for an encoder that
    takes a quarter of the time (see README). Added tokens in a text are cut out first, as the library does.
    """

    def __init__(self, path: str):
        model = Tokenizer.from_file(path)
        added = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
        # The file writes printable bytes as themselves, the others as U+0100 and up.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model.get_vocab(with_added_tokens=False).items() if t not in added}
        self.model = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        probe = "It's  1²x\n\n é中 don't " + "".join(f" {a}x" for a in added)
        if model.encode(probe, add_special_tokens=False).ids != self.encode(probe).tolist():
            raise ValueError("the tokenizer must split texts by the byte-level pattern and change nothing before")

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, allowed_special="all")


@cache
def json_encoder(path: str) -> JsonEncoder:
    """One for each Python worker."""
    return JsonEncoder(path)


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole sequences but for the first."""
    first = length % most or most
    return [(0, first), *((start, most) for start in range(first, length, most))]


def token_pieces(df: DataFrame, path: str, most: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and the end id, cut where longer than ``most``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null or empty text has the end id alone; a null
    or repeated id is carried as it is; columns besides the two named are not read.
    """

    def make():
        encoder = json_encoder(path)

        def fn(batch: pa.RecordBatch) -> dict:
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = np.append(encoder.encode(text), end_id)
                data = own.astype("<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(own), most)):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(data[4 * start : 4 * (start + length)])
            return {
                "doc_id": batch.column(0).take(pa.array(rows, pa.int32())),
                "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
            }

        return fn

    texts = df.select(df[id_col].alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"
    return map_texts(texts, "text", schema, make)


def reduce_instance(counts: dict[int, int], most: int) -> tuple[dict[Pattern, int], dict[int, int]]:
    """Patterns that some best packing holds, and what is left to pack.

    For a length L, a pattern {L, ...} dominates when every other set that fits beside L can be put, part
    by part, in the places of the pattern's other pieces; then it may be fixed for good:

    * nothing fits beside L: {L};
    * k is the longest that fits beside L, and fills the sequence or is at least as long as any two pieces
      that fit together, while no three fit: {L, k};
    * at most two pieces fit beside L, k is the longest single one, b the longest that fits with L and k,
      and the shorter piece of every pair that fits is at most b: {L, k, b}.

    Using pieces up takes sets away and adds none, so a pattern may be fixed as often as its pieces last.
    """
    left = Counter({length: n for length, n in counts.items() if n})
    fixed: Counter = Counter()
    before = -1
    while len(fixed) != before:
        before = len(fixed)
        for long in sorted(left, reverse=True):
            while left[long] and (pattern := _dominant(long, left, most)):
                need = Counter(pattern)
                times = min(left[x] // n for x, n in need.items())
                fixed[pattern] += times
                left.subtract({x: n * times for x, n in need.items()})
    return dict(fixed), {x: n for x, n in left.items() if n}


def _dominant(long: int, left: Counter, most: int) -> Pattern:
    room, stock = most - long, Counter(left)
    stock[long] -= 1
    fits = sorted(x for x, n in stock.items() if n and x <= room)
    if not fits:
        return (long,)
    k, pairs = fits[-1], _pairs(fits, stock, room)
    if k == room or not pairs:
        return (long, k)
    smallest = _smallest(fits, stock, 3)
    if len(smallest) == 3 and sum(smallest) <= room:
        return ()
    if max(map(sum, pairs)) <= k:
        return (long, k)
    beside = [x for x in fits if x <= room - k and stock[x] > (x == k)]
    return (long, k, beside[-1]) if beside and max(map(min, pairs)) <= beside[-1] else ()


def _smallest(fits: list[int], stock: Counter, n: int) -> list[int]:
    out: list[int] = []
    for x in fits:
        out += [x] * min(n - len(out), stock[x])
        if len(out) == n:
            break
    return out


def _pairs(fits: list[int], stock: Counter, room: int) -> list[tuple[int, int]]:
    """For each shorter piece, the longest that fits with it."""
    found = []
    for x in fits:
        at = bisect_right(fits, room - x) - 1
        while at >= 0 and fits[at] == x and stock[x] < 2:
            at -= 1
        if at >= 0 and fits[at] >= x:
            found.append((x, fits[at]))
    return found


def best_fit(counts: dict[int, int], most: int) -> dict[Pattern, int]:
    """Longest first, each piece into the fullest sequence that takes it, many equal pieces at a time."""
    open_by_room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if not open_by_room[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_by_room[room][pattern] = open_by_room[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = most // length
                if n >= each:
                    put((length,) * each, most - length * each, n // each)
                if n % each:
                    put((length,) * (n % each), most - length * (n % each), 1)
                break
            room = rooms[at]
            pattern, there = next(iter(open_by_room[room].items()))
            each = min(room // length, n)
            # A sequence that takes one piece stays the fullest that takes the next, as long as it can.
            times = min(there, n // each)
            del open_by_room[room][pattern]
            if there > times:
                open_by_room[room][pattern] = there - times
            if not open_by_room[room]:
                rooms.remove(room)
            put(pattern + (length,) * each, room - length * each, times)
            n -= times * each
    packed: dict[Pattern, int] = Counter()
    for group in open_by_room.values():
        for pattern, n in group.items():
            packed[tuple(sorted(pattern, reverse=True))] += n
    return dict(packed)


def plan(counts: dict[int, int], most: int) -> dict[Pattern, int]:
    """How many sequences are filled by each pattern of lengths."""
    fixed, rest = reduce_instance(counts, most)
    patterns = Counter(fixed)
    patterns.update(best_fit(rest, most))
    return dict(patterns)


def _places(patterns: dict[Pattern, int]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """Runs of ranks of a length: length, first rank, one past the last, first sequence, places in it, offsets."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        offsets, at = defaultdict(list), 0
        for length in pattern:
            offsets[length].append(at)
            at += length
        for length, own in offsets.items():
            n = times * len(own)
            rows.append((length, used[length], used[length] + n, sequence, len(own), own))
            used[length] += n
        sequence += times
    return rows


def pack(pieces: DataFrame, most: int, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, their place in sequences of at most ``most`` tokens.

    ``length`` must lie between 1 and ``most``. Equal rows get a place each. An empty table gives no rows.
    Offsets leave no gap. The pieces are read three times, so hand over a written table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(length is None or not 1 <= length <= most for length in counts):
        raise ValueError(f"every length must lie between 1 and {most}")
    runs = _places(plan(counts, most))
    spark = pieces.sparkSession
    runs_schema = "length bigint, first bigint, past bigint, sequence bigint, places int, offsets array<int>"
    table = spark.createDataFrame(runs, runs_schema)

    # Ranks within a length: parts of bounded size are ranked on their own and start at the sum before them.
    parts = max(1, sum(counts.values()) // RANK_ROWS)
    part = F.pmod(F.xxhash64(*key), F.lit(parts))
    dealt = pieces.withColumn("_part", part)
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("length", "_part").orderBy(*key)
    ranked = dealt.withColumn("_row", F.row_number().over(own) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_start"))

    # A length's runs lie end to end, so its pieces fall into one each; a few runs per length in an array.
    by_length = table.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "past", "sequence", "places", "offsets"))).alias("_runs")
    )
    placed = ranked.join(F.broadcast(by_length), "length")  # at most `most` rows, their runs bounded by the plan
    run = F.element_at(F.filter("_runs", lambda r: (r.first <= F.col("_rank")) & (F.col("_rank") < r.past)), 1)
    placed = placed.withColumn("_run", run)
    at = F.col("_rank") - F.col("_run.first")
    return placed.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(at / F.col("_run.places"))).alias("sequence_id"),
        F.element_at(F.col("_run.offsets"), (at % F.col("_run.places")).cast("int") + 1).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, path: str, most: int, end_id: int, digest: dict | None = None) -> DataFrame:
    """Token pieces packed; ``digest`` (columns made from ``ids``) stands for the ids where these aren't wanted."""
    pieces = token_pieces(df, path, most, end_id)
    if digest is not None:
        pieces = pieces.select("doc_id", "piece", "start", "length", *(c.alias(n) for n, c in digest.items()))
    return pack(materialise(pieces, "pieces"), most)
