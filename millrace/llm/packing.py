"""Best-fit packing with swap-based local search.

Documents are tokenized and cut once; from then on a piece is only a length. The
driver sees the histogram of lengths (at most one row per length up to the
capacity), and plans with classes of equal bins: a pattern of lengths and how
many bins hold it. Best fit by decreasing length fills the classes; local search
then exchanges one document for one, two for one, or moves one between underfull
bins wherever that raises the sum of squared fills, until emptied bins vanish
and no exchange helps. A search is for a bounded number of pieces: of more, the
counts are searched in proportion, and what that leaves over again, so the plan
and the driver's time grow with the logarithm of the pieces.

Pieces get their place by rank within their length, numbered inside hash buckets
whose counts give the offsets; no task sorts all pieces of one length.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table, ship_by_value, worker_cache

CAPACITY = 2048
END = 0
BUCKETS = 1024
#: Pieces that one search is for; more are searched in proportion.
PLANNED = 32_768

Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order of places

#: White space of str that the tokenizer's pattern does not count as such; texts with these are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space other than space and line end; a text with any is cut by the pattern below.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The tokenizer's own pattern always breaks here, so chunks can be encoded one by one.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
_PLAIN = re.compile("[\x00-\x1b\x20-\u024f]*\\Z")
_WORD_AND_MARK = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)\\Z")
_MAX_CACHED, _MAX_CHUNK = 200_000, 40


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The ids are those of `tokenizers` with the given file. Chunks between white
    space recur, so their ids are kept; a new chunk of plain Latin text is
    encoded from the same vocabulary's rank file, which is several times faster
    a chunk (a test holds both equal), and any other by `tokenizers` itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.full.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.line_end = self.whole("\n")
        for mark in ".,":
            self.chunk(mark)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, a space before it or not, or of a run of white space."""
        ids = self.known.get(chunk)
        if ids is None:
            m = _WORD_AND_MARK.match(chunk)
            if m:  # letters and a mark are pieces of their own by the pattern
                ids = self.piece(m[1]) + (self.piece(m[2]) if m[2] else b"")
            else:
                ids = array("I", self.fast.encode_ordinary(chunk)).tobytes() if _PLAIN.match(chunk) else self.whole(chunk)
            if len(chunk) <= _MAX_CHUNK and chunk[0] != " ":
                if len(self.known) >= _MAX_CACHED:
                    self.known.clear()
                self.known[chunk] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.after_space.get(piece[1:]) if piece[0] == " " else self.known.get(piece)
        return array("I", self.fast._encode_single_piece(piece)).tobytes() if ids is None else ids

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.whole(text)
        known, chunk = self.known, self.chunk
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or _OTHER_SPACE.search(text):
            return b"".join([known.get(c) or chunk(c) for c in _CHUNK.findall(text)])
        # Each space and line end stands alone between other characters: the pattern breaks before every one of
        # them, and keeps a space, but not a line end, with what follows.
        after_space, spaced, found = self.after_space, self.spaced, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if head:
                found.append(known.get(head) or chunk(head))
            found += [after_space.get(w) or spaced(w) for w in rest]
            found.append(self.line_end)
        return b"".join(found[:-1])

    def spaced(self, word: str) -> bytes:
        """Ids of a space and the word after it."""
        ids = self.chunk(" " + word)
        if len(word) <= _MAX_CHUNK:
            if len(self.after_space) >= _MAX_CACHED:
                self.after_space.clear()
            self.after_space[word] = ids
        return ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which takes the rest."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _pieces(files: tuple[str, str, str] | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        where = files or tokenizer_files()
        if ("encoder", where) not in cache:
            cache["encoder", where] = Encoder(*where)
        encoder = cache["encoder", where]
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + END.to_bytes(4, "little")
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append(i)
                    out.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            k, start, n, crc = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit by decreasing length over a histogram: (pattern, bins) classes."""
    free: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted keys of `free`

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if room not in free:
            free[room] = []
            bisect.insort(rooms, room)
        free[room].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            pattern, bins = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            used = min(left, bins)
            if used < bins:
                put(room, pattern, bins - used)
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(room - length, grown, used)
            left -= used
        each = capacity // length
        if left >= each:
            put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    return [(pattern, bins) for room in sorted(free) for pattern, bins in free[room]]


def fill(pattern: Pattern) -> int:
    return sum(length * times for length, times in pattern)


def exchanged(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    counts = dict(pattern)
    for x in out:
        counts[x] -= 1
    for x in into:
        counts[x] = counts.get(x, 0) + 1
    return tuple(sorted(((k, v) for k, v in counts.items() if v), reverse=True))


class Exchanges:
    """The underfull patterns, found by what an exchange needs.

    A giver with `room` gives x, a taker with `left` gives back y: one document,
    two (not both sides), or none for a move of one. The taker then has
    s = y + left to put x into, and squared fills rise if y < x <= s < x + room.
    By s, takers are kept with their y; by x, givers with their room.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.takers = [[{} for _ in range(capacity + 1)] for _ in range(3)]
        self.givers = [[{} for _ in range(capacity + 1)] for _ in range(3)]
        self.least = np.full((3, capacity + 1), capacity + 1, dtype=np.int64)  # y by documents given back and s
        self.most = np.full((3, capacity + 1), -1, dtype=np.int64)  # room by documents given and x
        self.bins: dict[Pattern, int] = {}

    def change(self, pattern: Pattern, bins: int) -> None:
        before = self.bins.get(pattern, 0)
        if before + bins:
            self.bins[pattern] = before + bins
        else:
            del self.bins[pattern]
        if before and before + bins:
            return
        room = self.capacity - fill(pattern)
        for n, y, _ in ((0, 0, ()), *((len(out), x, out) for x, out in all_offers(pattern))):
            for table, edge, at, value, pick, none in ((self.takers, self.least, y + room, y, min, self.capacity + 1), (self.givers, self.most, y, room, max, -1)):
                if table is self.givers and not n:
                    continue
                cell = table[n][at]
                if before:
                    del cell[value][pattern]
                    if not cell[value]:
                        del cell[value]
                else:
                    cell.setdefault(value, {})[pattern] = None
                edge[n, at] = pick(cell, default=none)

    def partner(self, values: dict[int, dict[Pattern, None]], wanted, pattern: Pattern) -> tuple[int, Pattern] | None:
        for value in sorted(values):
            if wanted(value):
                for other in values[value]:
                    if other != pattern or self.bins[pattern] > 1:
                        return value, other
        return None

    def move_with(self, pattern: Pattern):
        """(giver, taker, lengths given, lengths given back) with the least room left in the taker, or None."""
        room, best = self.capacity - fill(pattern), None
        mine = all_offers(pattern)
        for x, out in mine:
            for n in (0, 1, 2) if len(out) == 1 else (1,):
                for at in np.flatnonzero(self.least[n, x : min(x + room, self.capacity + 1)] < x).tolist():
                    if best and at >= best[0]:
                        break
                    if found := self.partner(self.takers[n][x + at], lambda y, x=x: y < x, pattern):
                        best = at, pattern, found[1], out, lengths_of(found[1], n, found[0])
                        break
        for y, into in ((0, ()), *mine):
            s = y + room
            for n in (1, 2) if len(into) == 1 else (1,):
                x = np.arange(y + 1, s + 1)
                for at in np.flatnonzero(x + self.most[n, y + 1 : s + 1] > s)[::-1].tolist():
                    left = s - (y + 1 + at)
                    if best and left >= best[0]:
                        break
                    if found := self.partner(self.givers[n][y + 1 + at], lambda r, left=left: r > left, pattern):
                        best = left, found[1], pattern, lengths_of(found[1], n, y + 1 + at), into
                        break
        return best and best[1:]


def all_offers(pattern: Pattern) -> list[tuple[int, tuple[int, ...]]]:
    """What a bin can give: each single document, and each sum of two once."""
    lengths = [k for k, _ in pattern]
    pairs = {a + b: (a, b) for i, a in enumerate(lengths) for b in lengths[i:] if a != b or pattern[i][1] > 1}
    return [(a, (a,)) for a in lengths] + list(pairs.items())


def lengths_of(pattern: Pattern, n: int, total: int) -> tuple[int, ...]:
    return next((out for x, out in all_offers(pattern) if x == total and len(out) == n), ())


def local_search(classes: list[tuple[Pattern, int]], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Exchanges between underfull bins until none raises the sum of squared fills.

    A pattern is settled when it has no exchange with any in the pool, as giver
    or as taker; only new patterns are looked at again, each against all others.
    """
    done = [c for c in classes if fill(c[0]) == capacity]
    pool = Exchanges(capacity)
    for pattern, bins in classes:
        if fill(pattern) < capacity:
            pool.change(tuple(sorted(pattern, reverse=True)), bins)
    todo = dict.fromkeys(sorted(pool.bins, key=fill, reverse=True))  # the emptiest is last, and first in turn
    while todo:
        pattern, _ = todo.popitem()
        while pattern in pool.bins and (move := pool.move_with(pattern)):
            giver, taker, out, into = move
            times = pool.bins[giver] // 2 if giver == taker else min(pool.bins[giver], pool.bins[taker])
            for old in (giver, taker):
                pool.change(old, -times)
            for new in (exchanged(giver, out, into), exchanged(taker, into, out)):
                if fill(new) == capacity:
                    done.append((new, times))
                elif new:
                    if new not in pool.bins:
                        todo[new] = None
                    elif pool.bins[new] == 1:
                        todo[new] = None  # it can now exchange with itself
                    pool.change(new, times)
    return done + sorted(pool.bins.items(), reverse=True)


def search(counts: dict[int, int], capacity: int = CAPACITY, planned: int = PLANNED) -> list[tuple[Pattern, int]]:
    """Classes of a histogram of any number of pieces, searched for no more than `planned` pieces at a time.

    Counts are divided by the power of two that leaves so many; the classes found stand
    for as many bins each. What the division leaves over, a sixteenth, and the emptiest
    of these bins, as long as they hold a twentieth of the pieces at most, are the next
    histogram, a fifth of the last or less; the last one is not divided. So time and
    classes grow with the number of digits of the counts. Up to `planned` pieces it is one search.
    """
    classes: list[tuple[Pattern, int]] = []
    while True:
        shift = (sum(counts.values()) // planned).bit_length()
        if not shift:
            return classes + local_search(best_fit(counts, capacity), capacity)
        # A sixteenth stays behind, so that what is left has its share of the short pieces that fill gaps.
        part = {length: m - m // 16 for length, n in counts.items() if (m := n >> shift)}
        found = local_search(best_fit(part, capacity), capacity)
        counts = {length: left for length, n in counts.items() if (left := n - (part.get(length, 0) << shift))}
        spare = sum(part.values()) // 20
        for pattern, bins in sorted(found, key=lambda c: fill(c[0])):
            spare -= bins * sum(times for _, times in pattern)
            if spare < 0 or fill(pattern) == capacity:
                classes.append((pattern, bins << shift))
                spare = -1
            else:
                for length, times in pattern:
                    counts[length] = counts.get(length, 0) + (bins * times << shift)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Segments of ranks by length: key (length, first rank), first sequence, offset, and how often the pattern repeats the length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, bins in search(counts, capacity):
        offset = 0
        for length, times in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset, times))
            taken[length] = taken.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "times": table[:, 4]}


def placed(segments: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the piece with this rank among the pieces of its length."""
    keys = (segments["length"] << 48) | segments["rank"]
    at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
    within = rank - segments["rank"][at]
    times = segments["times"][at]
    return segments["sequence"][at] + within // times, segments["offset"][at] + within % times * length


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = placed(segments, length, rank)
            names = [*batch.schema.names[:5], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece with its sequence and offset.

    A null or empty text is the end token alone. Repeated rows are packed like
    any others; pieces equal in every column are interchangeable. Null ids are
    kept. Extra columns are ignored; an empty table gives an empty result. Whole
    texts are tokenized; only those above the capacity are cut.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    pieces = slim.mapInArrow(_pieces(files, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS))), "pack-pieces")
    counts = materialize(pieces.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    segments = spark.sparkContext.broadcast(plan(histogram, capacity))
    by_length = Window.partitionBy("length").orderBy("_b")
    offsets = counts.select(F.col("length").alias("_l"), F.col("_b").alias("_k"), (F.sum("_n").over(by_length) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece", "ids_crc32")
    joined = pieces.join(offsets, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_k")))
    ranked = joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias("_rank"))
    return ranked.mapInArrow(_place(segments), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


ship_by_value(__name__)
