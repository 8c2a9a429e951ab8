"""Packing documents into token windows by best-fit decreasing.

Every document becomes its token ids and an end id.  A document longer than the window is first cut into full windows;
what is left of it, and every shorter document, is placed longest first into the open window with the least
room that still holds it.  A segment tree over the 0..window remaining capacities finds that window in
log2(window) steps.

Pieces are dealt to groups of about ``GROUP_TOKENS`` tokens by a hash of what they are, and each group is packed by one
task, so memory and padding (a window or so per group) are bounded whatever the input's size.

Defined cases: a null text is an empty text, packed as its end id; no document is dropped or shortened; repeated rows
are packed as separate documents; ties in length go by key, place and checksum; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktape.llm.tables import text_of, written

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
#: Words a Python worker remembers the ids of; the store is emptied when it is full.
CACHED_WORDS = 300_000
_GROUP_WINDOWS = 1 << 24

# Fixed value: how the vocabulary file's own pre-tokenizer splits normalised text.
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTERS = " \t\n\r"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids (little-endian 32-bit) of blank-separated words, filled on demand.

    The vocabulary file never joins across blanks, so a text's ids are its words' ids in order.  Words of
    letters that normalisation cannot change go to the model directly; all others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.split = regex.compile(_PRETOKENS).findall
        self.pieces: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.byte_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([self.byte_char[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        # Latin letters up to U+017F are composed already and lower-case one to one, except U+0130
        if "<|" not in word and word.isprintable() and (word.isascii() or (max(word) <= "ſ" and "İ" not in word)):
            store, out = self.pieces, []
            if len(store) >= CACHED_WORDS:
                store.clear()
            for piece in self.split(word.lower()):
                ids = store.get(piece)
                if ids is None:
                    ids = store[piece] = self._piece(piece)
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if "<|" in text:  # a special token may hold or touch anything
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        for blank in _SPLITTERS[1:]:
            text = text.replace(blank, " ")
        get, words = self.__getitem__, text.split(" ")
        out = [get(w) for w in words if w] if len(words) < 1 << 16 else None
        if out is not None:
            return b"".join(out)
        joined = bytearray()  # very long texts: no list of all words' ids
        for at in range(0, len(words), 1 << 16):
            joined += b"".join([get(w) for w in words[at : at + (1 << 16)] if w])
        return bytes(joined)


_STORES: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _STORES:
        _STORES[vocabulary] = WordIds(vocabulary)
    return _STORES[vocabulary]


# --- packing --------------------------------------------------------------------------------------------------


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, number: int, room: int) -> None:
        if room:
            self.by_room[room].append(number)
            node = self.leaves + room
            while node:
                self.count[node] += 1
                node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """The open window with the least room of at least ``length``, and that room."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node ^ 1]):  # up, until a right neighbour holds one
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        number = self.by_room[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return number, room


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each length, taken in the given (decreasing) order."""
    opened, numbers, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = opened.take_tightest(length)
        if found is None:
            found = n, window
            n += 1
        number, room = found
        numbers.append(number)
        offsets.append(window - room)
        opened.put(number, room - length)
    return numbers, offsets


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Full windows and remainders of every document; with ``ids`` also their token ids (``array<int>``)."""
    import numpy as np

    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, end, width = word_ids(vocabulary), END_ID.to_bytes(4, "little"), 4 * window
        for batch in batches:
            rows = []
            for name, body in zip(batch["key"], batch["text"]):
                found = store.of(body) + end
                for at in range(0, len(found), width):
                    piece = found[at : at + width]
                    row = (name, at // 4, len(piece) // 4, zlib.crc32(piece), len(found) // 4)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if ids else row)
                if ids and len(rows) > 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"key": object}) if not len(out) else out

    source = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    schema = T._parse_datatype_string(f"key {source.schema['key'].dataType.simpleString()}, {PIECE}{', ids array<int>' if ids else ''}")
    names = schema.names
    return source.mapInPandas(cut, schema)


def assign(cut: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``.  ``cut`` is read twice, so it should be a written table."""
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    if groups * _GROUP_WINDOWS >= 1 << 63:
        raise ValueError("too many groups for a 64-bit sequence id")
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("key", "start", "ids_crc32", "length"), F.lit(groups)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        numbers, offsets = best_fit(rows["length"].tolist(), window)
        first = int(rows["pack"].iloc[0]) * _GROUP_WINDOWS
        return rows.assign(sequence_id=[first + n for n in numbers], offset=offsets)

    return dealt.groupBy("pack").applyInPandas(pack, schema).drop("pack")


def packed(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset there; with ``ids`` also its token ids."""
    cut = written(pieces(docs, vocabulary, window, key, text, ids), "pieces")
    if not ids:
        return assign(cut, window).withColumnRenamed("key", key)
    placed = assign(cut, window)
    return placed.withColumnRenamed("key", key)


def sequences(packed_with_ids: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences: ``sequence_id``, ``n_tokens`` and ``ids``, padded to the window unless their length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n)
    return joined.select("sequence_id", n.alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
