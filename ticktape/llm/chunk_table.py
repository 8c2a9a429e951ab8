"""SentencePiece ids by a table of distinct chunks, and texts back from ids.

In normalised text every blank is a marker.  Where no piece of the vocabulary holds a marker after anything else, and none a line end,
no merge can cross from the end of a word into the next marker or line end, so a text's ids are the ids of its chunks (markers or
line ends and what follows them, up to the next ones) one after the other.  A task keeps a table of the distinct chunks it has met: new ones are segmented together,
once, and every text's ids are taken from the table by the places of its chunks.

The table lives in the task: in prose two thirds of all distinct chunks are seen once, and joining them back through a
shuffle would move several times the corpus.  It is started anew at ``CHUNKS`` entries, and texts are worked off in slices of about
``SLICE`` characters that end before a chunk, so memory is bounded by the longest word, not by the longest text.  A lost task is
run again on its own rows.  A vocabulary whose pieces cross markers, or that normalises more than blanks, is served by the library on
whole texts.

Defined cases: a null text is an empty one, which has the end id only; the marker's own character reads as a blank and comes back as
one; ids out of the vocabulary are an error, null ids decode to an empty text; repeated rows are rows of their own; other columns,
whatever their names, are kept in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ticktape.llm.tables import text_of

MARK, LINE = "▁", "\n"
CHUNKS, SLICE, JOINED = 300_000, 1 << 20, 2000
_CHUNK = re.compile(f"(?:{MARK}+|{LINE}+)[^{MARK}{LINE}]*")
_BEGIN = re.compile(f"(?<!{MARK}){MARK}|(?<!{LINE}){LINE}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def separable(model) -> bool:
    """Whether texts may be segmented chunk by chunk: no piece crosses into a marker, none holds a line end, only blanks are
    normalised."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
    crossing = any(" " in p or LINE in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
    probe = " a  ﬁ é½ \t　Ａ \n"
    return not crossing and MARK in pieces and model.normalize(probe) == MARK + probe.replace(" ", MARK)


class ChunkTable(dict):
    """Numbers of chunks; their ids lie one after the other in ``ids``, ``sizes[n]`` of them from ``starts[n]``."""

    def __init__(self, vocabulary: str):
        super().__init__()
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.separable = separable(model)
        spelled = [(model.id_to_piece(i), model.is_control(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        #: What a piece stands for; None for the unknown one, which the library spells in its own way.
        self.spelled = [b"" if c else bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, c, b in spelled]
        self.spelled[model.unk_id()] = None
        self.marked = [p.startswith(MARK) for p, _, _ in spelled]
        #: Bytes of marked text that a piece covers.
        self.covers = np.array([1 if b else len(p.encode()) for p, _, b in spelled])
        self.lead = len(model.encode(LINE))
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = number = len(self)
        return number

    def _segment(self) -> None:
        """Segments the new chunks, many to a call, and finds where each one's ids end by the bytes that they cover.

        A line end goes before them: the library's own marker sticks to it and not to the first chunk.  A chunk of markers
        alone, which stands at a text's end, goes by itself, as the next one's markers would join it.
        """
        texts, size = [[]], 0
        for chunk in self.new:
            alone = not chunk.strip(MARK)
            if size > JOINED or alone:
                texts.append([])
                size = 0
            texts[-1].append(chunk)
            size = JOINED + 1 if alone else size + len(chunk)
        found = self.model.encode([LINE + "".join(t) for t in texts], num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids[self.lead :] for ids in found), np.int32)
        ends = np.searchsorted(np.cumsum(self.covers[flat]), np.cumsum([len(c.encode()) for c in self.new])) + 1
        sizes = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - sizes])
        self.sizes, self.ids, self.new = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, flat]), []

    def _taken(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices of marked text, taken from the table by the places of their chunks, and each slice's number of ids."""
        if len(self) >= CHUNKS:
            self._empty()
        chunks = [_CHUNK.findall(s) for s in slices]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64)
        if self.new:
            self._segment()
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.cumsum([0, *map(len, chunks)])])

    def of(self, texts: list[str], size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, each text's with the end id behind, and where each ends."""
        if not self.separable:
            found = [np.asarray(i, np.int32) for i in self.model.encode(texts, add_eos=True, num_threads=1)]
            return np.concatenate([np.empty(0, np.int32), *found]), np.cumsum([len(i) for i in found], dtype=np.int64)
        out, counts, waiting, held = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64), [], 0

        def work() -> None:
            ids, sizes = self._taken([s for _, s in waiting])
            out.append(ids)
            np.add.at(counts, [n for n, _ in waiting], sizes)
            waiting.clear()

        for n, text in enumerate(texts):
            for part in slices(MARK + text.replace(" ", MARK), size) if text else ():
                waiting.append((n, part))
                held += len(part)
                if held >= size:
                    work()
                    held = 0
        if waiting:
            work()
        ends = np.cumsum(counts)
        return np.insert(np.concatenate(out), ends, self.model.eos_id()), ends + np.arange(1, len(texts) + 1)

    def text(self, ids: list[int]) -> str:
        """What the library decodes: the pieces' spellings in a row, without the first marker.  Ids that begin with a piece for
        nothing, are unknown or spell no UTF-8 are left to it."""
        try:
            if ids and self.spelled[ids[0]]:
                return b"".join([self.spelled[i] for i in ids])[self.marked[ids[0]] :].decode()
        except (TypeError, UnicodeDecodeError):
            pass
        return self.model.decode(ids)


def slices(marked: str, size: int = SLICE) -> Iterator[str]:
    """``marked`` in slices of about ``size`` characters, each beginning with a chunk."""
    begin = 0
    while len(marked) - begin > size:
        following = _BEGIN.search(marked, begin + size)
        if following is None:
            break
        yield marked[begin : following.start()]
        begin = following.start()
    yield marked[begin:]


_TABLES: dict[str, ChunkTable] = {}


def table(vocabulary: str) -> ChunkTable:
    if vocabulary not in _TABLES:
        _TABLES[vocabulary] = ChunkTable(vocabulary)
    return _TABLES[vocabulary]


def runs(batch: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """A batch in runs of rows of about ``most`` bytes, so that a worker holds the lists of few texts at a time."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)), 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def _spans(lists: pa.Array) -> Iterator[list[int]]:
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for a, b, valid in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist()):
        yield values[a:b].tolist() if valid else []


def ids_of(text: Column, vocabulary: str | None = None) -> Column:
    """The ids of a text column, end id included."""
    vocabulary = vocabulary or default_vocabulary()

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for run in runs(batch):
                yield _lists(*table(vocabulary).of(run.to_pylist()))

    return encode(text)


def text_from(ids: Column, vocabulary: str | None = None) -> Column:
    """The text that the library decodes from a column of ids."""
    vocabulary = vocabulary or default_vocabulary()

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(table(vocabulary).text, _spans(batch)), pa.string())

    return decode(ids)


def both_of(text: Column, vocabulary: str | None = None) -> Column:
    """``ids`` of a text column and the text ``decoded`` from them, by one Python worker."""
    vocabulary = vocabulary or default_vocabulary()

    @arrow_udf("ids array<int>, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for run in runs(batch):
                ids = _lists(*table(vocabulary).of(run.to_pylist()))
                texts = pa.array(map(table(vocabulary).text, _spans(ids)), pa.string())
                yield pa.StructArray.from_arrays([ids, texts], ["ids", "decoded"])

    return code(text)


def encoded(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``row`` (the input row) and ``ids`` of every document."""
    return docs.select(F.struct("*").alias("row"), ids_of(text_of(text), vocabulary).alias("ids"))


def decoded(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the text ``decoded`` from their ids."""
    return rows.withColumn("decoded", text_from(F.col(ids), vocabulary))


def coded(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``row`` (the input row), ``ids`` and the text ``decoded`` from them."""
    both = docs.select(F.struct("*").alias("row"), both_of(text_of(text), vocabulary).alias("both"))
    return both.select("row", "both.ids", "both.decoded")
