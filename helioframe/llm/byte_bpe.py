"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A block of documents becomes one row: the distinct words (pieces of the pre-tokeniser's pattern) that are
new to its task, as arrays of byte ranks, and for every document which words follow each other. Higher-order functions fold each
distinct word: in every step the neighbouring pair of the lowest rank merges, until no pair is in the rank
map; then they decode it, concatenating the binary pieces of its ids. The map is a literal of the plan: two constant arrays, with the rank of (left, right) at base[left] +
right, as the look-up in Spark's own map type is a linear search. Then the encoded and the
decoded words are strung together for each document; decode() takes whole documents' ids. No row is shuffled; what a task holds is bounded by BLOCK_BYTES (or one longer text) and MAX_WORDS.

Words of more than FOLD_BYTES bytes, on which the folding would take quadratic time, are merged with a heap
by the same rule. Ranks are read on the driver from a file whose path is a parameter; they must be below
2^MOST_RANK_BITS. Words are told apart by 64-bit hashes in which no two bytes of a word have the same key.

Null texts count as empty: no ids. Repeated rows are each reported, extra columns are ignored, an empty
table gives no rows. A pattern other than the default one needs its own splitter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import in_arrow, release
from helioframe.llm.text_arrays import slices, text_bytes, word_hashes

BLOCK_BYTES = 1 << 20
#: A task starts a new list of words beyond so many.
MAX_WORDS = 400_000
FOLD_BYTES = 96
#: Bits of a place in a word, of the largest ranks there may be, and of the right one of two in a key.
PLACE_BITS = 8
MOST_RANK_BITS = 21
RIGHT = 32
#: An empty cell of the rank table, while it is filled.
EMPTY = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


# --- the pre-tokeniser ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(0x110000, dtype=np.int8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pattern's matches, and the first of each text (n+1 indexes).

    Runs of one class, with three exceptions: a single space joins the run after it; of white space
    before other text, the last character stands alone; 's, 't, 're, 've, 'm, 'll, 'd stand alone.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    text = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(text)
    byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = classes()[text]
    new_doc = np.zeros(n + 1, dtype=bool)
    new_doc[np.searchsorted(byte_at, offsets)] = True
    new_doc[n] = True
    run = np.ones(n, dtype=bool)
    run[1:] = (kind[1:] != kind[:-1]) | new_doc[1:n]
    cut = np.concatenate((run, [True]))
    # white space with other text after it, in the same document: its last character is cut off
    before = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~new_doc[1:n])
    cut[before] = True
    cut[before[text[before] == 0x20] + 1] = False
    quote = np.flatnonzero((text[:-1] == 0x27) & cut[:-2] & (kind[1:] == 1) & ~new_doc[1:n])
    if len(quote):
        padded = np.concatenate((text, np.zeros(2, np.uint32)))
        ended = np.concatenate((new_doc, [True, True]))
        a, b = padded[quote + 1], np.where(ended[quote + 2], 0, padded[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        at, size = quote[one | two], np.where(one, 2, 3)[one | two]
        cut[at + 1] = False
        cut[np.minimum(at + size, n)] = True
    starts = np.flatnonzero(cut[:-1])
    bounds = np.concatenate((byte_at[starts], [len(raw)]))
    return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], offsets)


# --- the rank map --------------------------------------------------------------------------------


def merges(ranks: dict[bytes, int]) -> dict[int, int]:
    """left << RIGHT | right -> rank of the two together, for all pairs of entries whose join is an entry."""
    out = {}
    for word, rank in ranks.items():
        for k in range(1, len(word)):
            left, right = ranks.get(word[:k]), ranks.get(word[k:])
            if left is not None and right is not None:
                out[left << RIGHT | right] = rank
    return out


def rank_bits(ranks: dict[bytes, int]) -> int:
    """Bits of the largest rank."""
    bits = max(ranks.values()).bit_length()
    if bits > MOST_RANK_BITS:
        raise ValueError(f"ranks of {bits} bits; at most {MOST_RANK_BITS} fit the table")
    return bits


def rank_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The merges as overlaid rows: the entry of (left, right) is at base[left] + right; and the bits of a rank.

    An entry holds its left rank above those bits, so that a cell of another row is told apart. Rows are
    laid, longest first, where all their cells are free; the search goes on from where the last row of the
    same length was laid.
    """
    bits = rank_bits(ranks)
    rows: dict[int, list[tuple[int, int]]] = {}
    for key, rank in merges(ranks).items():
        rows.setdefault(key >> RIGHT, []).append((key & (1 << RIGHT) - 1, rank))
    width = max(ranks.values()) + 1
    table = np.full(20 * width, EMPTY, dtype=np.int64)
    base = np.zeros(width, dtype=np.int64)
    free_from, at, length = 0, 0, 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        cells = np.array([b for b, _ in row])
        if len(row) == 1:
            at = max(0, free_from - int(cells[0]))
        elif len(row) != length:
            at, length = max(0, free_from - int(cells.min())), len(row)
        while True:
            tries = np.arange(at, at + 512)
            fits = (table[tries[:, None] + cells] == EMPTY).all(1)
            if fits.any():
                at = int(tries[fits.argmax()])
                break
            at += 512
        base[left] = at
        table[at + cells] = (left << bits) | np.array([r for _, r in row])
        while table[free_from] != EMPTY:
            free_from += 1
    table = table[: int(np.flatnonzero(table != EMPTY).max(initial=0)) + width]
    return base, np.where(table == EMPTY, width << bits, table), bits  # the row of no rank


@lru_cache(maxsize=2)
def table_of(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    return rank_table(read_ranks(path))


def literal(values: np.ndarray) -> Column:
    """A constant array of the plan."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def fold_word(word: Column, base: Column, table: Column, bits: int) -> Column:
    """Merge the neighbours of the lowest rank, the leftmost first, until none is in the table.

    word: an array of longs, the ranks of the word's bytes. The fold has one step per byte; a step that
    finds no pair marks the end by a leading -1, and the steps after it pass the array through.
    """

    def ranked(state: Column) -> Column:
        """Rank and place of each pair, packed; a pair that is not in the table is above any rank."""
        entry = lambda a, i: F.get(table, F.get(base, a) + F.get(state, i + 1)).bitwiseXOR(F.shiftleft(a, bits))
        return F.transform(state, lambda a, i: F.shiftleft(entry(a, i), PLACE_BITS).bitwiseOR(i.cast("bigint")))

    def merge(state: Column, best: Column) -> Column:
        place = best.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        merged = F.concat(F.slice(state, F.lit(1), place), F.array(F.shiftright(best, PLACE_BITS)), F.slice(state, place + 3, F.size(state)))
        return F.when(best < F.lit(1 << bits + PLACE_BITS), merged).otherwise(F.concat(F.array(F.lit(-1).cast("bigint")), state))

    def step(state: Column, _: Column) -> Column:
        # a list of one element gives its value a name
        merged = F.get(F.transform(F.array(F.array_min(ranked(state))), lambda best: merge(state, best)), F.lit(0))
        return F.when((F.size(state) < 2) | (F.get(state, F.lit(0)) == -1), state).otherwise(merged)

    return F.aggregate(F.sequence(F.lit(1), F.size(word)), word, step)


def merge_long(word: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges with a heap, for one long word."""
    left, right, alive = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1], [True] * len(word)
    word = list(word)
    heap = [(pairs[k], i, word[i], word[i + 1]) for i in range(len(word) - 1) if (k := word[i] << RIGHT | word[i + 1]) in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or word[i] != a or word[j] != b:
            continue
        word[i], alive[j], right[i] = rank, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (k := word[x] << RIGHT | word[y]) in pairs:
                heapq.heappush(heap, (pairs[k], x, word[x], word[y]))
    return [w for w, on in zip(word, alive) if on]


# --- blocks of documents -------------------------------------------------------------------------


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col and ids (array of ints) of each document.

    With digests, instead of ids: n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the bytes that the ids decode to).
    """
    ranks = read_ranks(rank_path)
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((of_byte, ranks))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_byte, ranks = sent.value
        pairs = None
        place: dict[int, int] = {}  # of the words so far in this task
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                raw, offsets = text_bytes(batch.column("text"))
                starts, ends, first = pieces(raw, offsets)
                distinct, one, use = np.unique(word_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
                fresh = len(place) > MAX_WORDS
                if fresh:
                    place.clear()
                begun = len(place)
                at = np.array([place.setdefault(h, len(place)) for h in distinct.tolist()], dtype=np.int32)
                new = np.flatnonzero(at >= begun)
                data = raw.tobytes()
                found = []
                for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist()):
                    rank = ranks.get(data[a:b])
                    if rank is not None:  # an entry as a whole is its own encoding
                        found.append(np.array([rank]))
                    elif b - a <= FOLD_BYTES:
                        found.append(of_byte[raw[a:b]])
                    else:
                        pairs = merges(ranks) if pairs is None else pairs
                        found.append(np.array(merge_long(of_byte[raw[a:b]].tolist(), pairs)))
                heads = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(heads), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                        pa.array([fresh]),
                        pa.array([first.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([at[use].tobytes() if len(use) else b""], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    ],
                    ["ids", "fresh", "first", "use", "words"],
                )

    schema = f"ids array<{kind}>, fresh boolean, first binary, use binary, words array<array<bigint>>"
    blocks = in_arrow(narrow, split, schema)
    base, table, bits = table_of(rank_path)
    base, table = literal(base), literal(table)
    # a leading -1 marks the end of a fold
    folded = blocks.withColumn("words", F.transform("words", lambda w: F.filter(fold_word(w, base, table, bits), lambda i: i >= 0)))
    if digests:
        hexed = piece_table(ranks)
        numbers = F.transform("words", lambda w: F.array_join(w.cast("array<string>"), ","))
        folded = folded.select("ids", "fresh", "first", "use", F.transform("words", F.size).alias("sizes"), numbers.alias("numbers"), F.transform("words", lambda w: joined_pieces(w, hexed)).alias("pieces"))
    release()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each block's row, whether its task's list of words begins anew, its identifiers and use of words."""
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                first, use = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in (("first", np.int64), ("use", np.int32)))
                yield row, row.column("fresh")[0].as_py(), row.column("ids").flatten(), first, use

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words' ids, one word after the other, and where each begins: of the words so far in this task."""
        known_ids, known_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for row, fresh, ids, first, use in documents(batches):
            if fresh:
                known_ids, known_at = known_ids[:0], known_at[:1]
            words = row.column("words").flatten()
            known_at = np.concatenate((known_at, known_at[-1] + np.cumsum(words.value_lengths().to_numpy(), dtype=np.int64)))
            known_ids = np.concatenate((known_ids, words.flatten().to_numpy().astype(np.int32)))
            size = np.diff(known_at)[use]
            heads = np.concatenate(([0], np.cumsum(size)))[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(heads), pa.array(known_ids[spread(known_at[use], size)]))], ["id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[bytes] = []
        pieces: list[bytes] = []
        sizes = np.zeros(0, np.int32)
        for row, fresh, ids, first, use in documents(batches):
            if fresh:
                numbers, pieces, sizes = [], [], sizes[:0]
            numbers += row.column("numbers").flatten().cast(pa.binary()).to_pylist()
            pieces += row.column("pieces").flatten().to_pylist()
            sizes = np.concatenate((sizes, row.column("sizes").flatten().to_numpy()))
            total = np.concatenate(([0], np.cumsum(sizes[use], dtype=np.int64)))
            order, shas, decoded = use.tolist(), [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                part = order[a:b]
                shas.append(hashlib.sha256(b",".join([numbers[w] for w in part])).hexdigest())
                decoded.append(hashlib.sha256(b"".join([pieces[w] for w in part])).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total[first[1:]] - total[first[:-1]]), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    if digests:
        return in_arrow(folded, digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
    return in_arrow(folded, join, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    heads = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(heads - starts, sizes)


def piece_table(ranks: dict[bytes, int]) -> Column:
    """The binary pieces by rank, in hexadecimal digits, as a constant of the plan."""
    of_rank = {rank: word for word, rank in ranks.items()}
    return F.split(F.lit(",".join(of_rank.get(k, b"").hex() for k in range(max(of_rank) + 1))), ",")


def joined_pieces(ids: Column, table: Column) -> Column:
    """The pieces of the ids, one after the other, as binary."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i.cast("int"))), ""))


def decode(encoded: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column text_bytes: the binary pieces of the ids, one after the other."""
    return encoded.withColumn("text_bytes", joined_pieces(F.coalesce(ids_col, F.array().cast("array<int>")), piece_table(read_ranks(rank_path))))
