"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become token ids; a document longer than a sequence is cut into whole sequences after a shorter first piece.
Pieces are dealt by a hash into groups of bounded size, and every group is packed in one task: best fit in falling
order, then local search over the underfull bins. A move takes a piece to a bin with room, an exchange swaps one piece
for one, or two for one, between two bins; each is done only if it raises the sum of squared fills, which drives some
bins to fill up and others to empty. Emptied bins go.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.sources.shared import stored

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces of one group at most, on average; a group is packed in one task.
GROUP_PIECES = 8_000
#: Cached words of a task.
CACHE_WORDS = 500_000
#: Characters that both tokenizer libraries class alike, beyond Latin-1.
KNOWN = re.compile(r"[^\n -~\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: Blanks other than single ones inside a line, and what might begin a special token.
ODD = ("  ", " \n", "\n ", "<|")


def _plain(text: str) -> bool:
    """Are pre-tokens sure to end before each blank?"""
    if text[0] == " " or text[-1] == " " or any(x in text for x in ODD):
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return KNOWN.search(text) is None
    return text.replace("\n", "").isprintable()


class _Words(dict):
    """Ids of a word with the blank before it; bounded, for words never end."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids


class Encoder:
    """Ids of a text as little-endian 32-bit bytes. Plain text goes word by word through a cache; all other text, and
    any that might hold a special token, goes whole through the tokenizer."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.word = self._slow
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.word = lambda text: array("I", encode(text)).tobytes()
        self.words = _Words(self.word)

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not _plain(text):
            return self._slow(text)
        first, *rest = text.split(" ")
        return b"".join([self.word(first), *map(self.words.__getitem__, rest)])


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, files: tuple[str, str | None] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document as ids and an end id, cut to the capacity.

    A null or empty text is its end id alone. Only a document of more than ``capacity`` ids is cut: into pieces of the
    capacity, the first of which may be shorter.
    """
    kind = docs.schema[id].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import public_tokenizers

        encode = Encoder(*(files or (public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken"))))
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch["text"]):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(row, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cut = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])
            yield cut.assign(id=batch["id"].iloc[cut["id"].to_numpy(int)].to_numpy())

    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths``: the longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted room sizes that have bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        k = bisect_left(rooms, need)
        if k == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
        bins[b].append(i)
        left = room - need
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Underfull:
    """The bins of a group with room, their pieces by length, and the exchanges between them."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.open = [b for b in range(len(bins)) if bins[b] and self.fill[b] < capacity]
        self.at = {i: b for b in self.open for i in bins[b]}
        self.pool = sorted((size[i], i) for i in self.at)
        self.rooms = sorted((capacity - self.fill[b], b) for b in self.open)

    def put(self, pieces: tuple[int, ...], source: int, target: int) -> None:
        for i in pieces:
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.at[i] = target
            self.fill[source] -= self.size[i]
            self.fill[target] += self.size[i]

    def noted(self, *bins: int) -> None:
        for b in bins:
            insort(self.rooms, (self.capacity - self.fill[b], b))

    def move(self, i: int, b: int) -> bool:
        """A piece into the fullest other bin with room, if that is then fuller than its own bin was."""
        k = bisect_left(self.rooms, (self.size[i], -1))
        while k < len(self.rooms):
            room, c = self.rooms[k]
            if self.capacity - self.fill[c] != room:  # an old note
                del self.rooms[k]
            elif c == b:
                k += 1
            else:
                break
        if k == len(self.rooms) or self.fill[c] + self.size[i] <= self.fill[b]:
            return False
        self.put((i,), b, c)
        self.noted(b, c)
        return True

    def exchange(self, out: tuple[int, ...], b: int) -> bool:
        """One or two pieces for one longer piece of a bin that is less full than this one becomes: the longest that fits."""
        mass, room = sum(self.size[i] for i in out), self.capacity - self.fill[b]
        k = bisect_left(self.pool, (mass + room + 1, -1)) - 1
        while k >= 0 and (length := self.pool[k][0]) > mass:
            j = self.pool[k][1]
            c = self.at[j]
            if c != b and self.fill[b] + length - mass > self.fill[c]:
                self.put((j,), c, b)
                self.put(out, b, c)
                self.noted(b, c)
                return True
            k -= 1
        return False


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: moves, one-for-one and two-for-one exchanges that raise the sum of squared fills, until there is none.

    Moving ``d`` tokens from a bin of fill ``a`` to one of fill ``b`` raises it if ``b + d > a``. Every piece of every
    underfull bin is tried for a move, and every piece and every two pieces (one of each length) for an exchange, against
    the pieces of all other underfull bins, by length. The sum is a whole number that is bounded, so the search ends.
    """
    size = [int(x) for x in lengths]
    changed = True
    while changed:
        changed, state = False, _Underfull(bins, size, capacity)
        for b in sorted(state.open, key=lambda b: state.fill[b]):
            for i in list(bins[b]):
                changed |= state.move(i, b)
            again = True
            while again and bins[b] and state.fill[b] < capacity:
                ones = list({size[i]: i for i in bins[b]}.values())
                twos = {size[i] + size[j]: (i, j) for n, i in enumerate(bins[b]) for j in bins[b][:n]}
                again = any(state.exchange((i,), b) for i in ones) or any(state.exchange(x, b) for x in twos.values())
                changed |= again
    return [b for b in bins if b]


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, id: str = "doc_id") -> DataFrame:
    """``cut`` (rows with ``length``) with ``sequence_id`` and ``offset``: places without gaps in sequences of at most ``capacity``.

    Rows are dealt to groups by a hash of all their columns and a running number, so that equal rows spread as well;
    an empty table gives an empty table. Sequence numbers are unique, not consecutive.
    """
    cut = stored(cut, "pieces")
    groups = -(-cut.count() // group_pieces) or 1
    width = 1 << 32
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(*cut.columns, F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_group").sort_values([c for c in rows.columns if c != "_group"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            number[b] = key[0] * width + k
            offset[b] = np.concatenate([[0], np.cumsum(lengths[b])[:-1]])
        return rows.assign(sequence_id=number, offset=offset)

    return dealt.groupBy("_group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(pieces(docs, id, text), id=id)


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return packed(table(spark, sf_dir, "documents"))
