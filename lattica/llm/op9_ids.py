"""Token ids of all documents in files of adaptive, context-mixed range-coded blocks.

Documents are dealt by ranges of doc_id and sorted; a task packs whole documents, about
FILE_IDS bytes of text a file (rangecoder holds the format: a document table, then blocks
that are reset and checked each for itself). Files are rows of a table in the shared
folder, in order of (part, seq), so a lost task leaves nothing half written.

Words repeat, so a file's different words are tokenised once each: the tokenizer drops
blanks and looks at nothing beyond them. A word of ASCII and Latin-1 letters, ASCII digits
and marks (but ' and |) is cut where the tokenizer cuts it, between letters, digits and
marks; its pieces, lower-cased and known by a worker, are merged by the tokenizer's model
many at a time, without its normaliser, which changes nothing in them. All other words,
and all words of a tokenizer of other rules, go through the whole tokenizer.

Defined results: a null or empty text has no ids but the end id; documents without
a doc_id come first; rows that share a doc_id follow each other by text; a very long text
is tokenised whole and lies in one file; an empty table gives no file and an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import runs
from .common import materialize, steps, table
from .rangecoder import TOTAL_AT, pack_words, spread, unpack

END_ID = 1
#: Bytes of text (and documents) of a file, more than its ids; the last document may go beyond.
FILE_IDS = 1 << 24
#: Pieces that a worker keeps the ids of from file to file, and pieces merged at once.
_KEPT, _AT_ONCE = 800_000, 256
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Letters, digits and marks of ASCII, by which words are cut; 0: not cut. (Marks: ' may begin a suffix, | a special token.)
_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.array([0 if not 32 < b < 127 or chr(b) in "'|" else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK for b in range(256)], np.uint8)
#: The rules that cutting words and merging their pieces follows.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_SUFFIX = "</w>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer; its model alone for pieces between blanks, which ids end a piece and how it writes the bytes of Latin-1 letters, or None if its rules are others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    rules = tuple(x and json.loads(x.__getstate__()) for x in (whole.normalizer, whole.pre_tokenizer))
    if rules != _RULES or getattr(whole.model, "end_of_word_suffix", None) != _SUFFIX or whole.post_processor is not None:
        return whole, None, None, None
    model = Tokenizer(whole.model)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    last = np.zeros(whole.get_vocab_size(), bool)
    last[[i for token, i in whole.get_vocab(with_added_tokens=False).items() if token.endswith(_SUFFIX)]] = True
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
    written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (*range(33, 127), *range(0xC0, 0x100))}
    return (whole, model, last, written) if all(written[c] == chr(c) for c in range(33, 127)) else (whole, None, None, None)


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.LargeStringArray:
    """data cut at ``starts``."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _bytes(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of strings that begin at their buffers' heads."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(strings) + 1]
    return np.frombuffer(data, np.uint8)[: int(offsets[-1])], offsets[:-1]


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, letters of Latin-1 included, and where the second bytes of these letters are."""
    kind = _KIND[data]
    latin = np.flatnonzero(data == 0xC3)
    second = latin + 1
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
    kind[latin] = _LETTER
    kind[second] = _LETTER
    return kind, second


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, lower-cased, and starts of the pieces of words; words of bytes without a kind are left whole as they are."""
    kind, second = _kinds(data)
    whole = np.add.reduceat(kind == 0, starts, dtype=np.int64) > 0
    free = ~np.repeat(whole, np.diff(np.append(starts, len(data))))
    low = data.copy()
    low[free & (data >= 65) & (data <= 90)] += 32
    low[second[free[second] & (data[second] <= 0x9E)]] += 32
    head = np.zeros(len(data), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    head &= free
    head[starts] = True
    return low, np.flatnonzero(head)


class _Pieces:
    """ids of words by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        self.whole, self.model, self.last, self.written = _tokenizer(path)
        # pieces by number, with the numbers of ids of each and the ids
        self.known, self.sizes, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, pieces: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))

    def _forget(self) -> None:
        """Leave the first _KEPT pieces, among which are the frequent ones."""
        while len(self.known) > _KEPT:
            self.known.popitem()
        self.sizes = self.sizes[:_KEPT]
        self.flat = self.flat[: int(self.sizes.sum())]

    def _merged(self, pieces: list[str]):
        """Numbers of ids of cut pieces, and the ids."""
        texts = [" ".join(pieces[i : i + _AT_ONCE]) for i in range(0, len(pieces), _AT_ONCE)]
        texts = [x if x.isascii() else x.translate(self.written) for x in texts]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(pieces) or (len(ends) and ends[-1] != len(flat)):
            return self._encoded(pieces)
        return np.diff(ends, prepend=0), flat

    def _encoded(self, words: list[str]):
        """Numbers of ids of words, and the ids, by the whole tokenizer."""
        lists = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in lists], np.int64), np.fromiter(chain.from_iterable(lists), np.uint32)

    def _numbers(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Numbers of different pieces, whose ids are known then."""
        data, starts = _bytes(pieces)
        names = np.insert(data, starts[1:], 0x20).tobytes().decode().split(" ")
        numbers = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        new = numbers < 0
        ascii_ = np.maximum.reduceat(data, starts) < 128
        if self.model is None:
            cut = np.zeros(len(names), bool)
        else:
            cut = np.add.reduceat(_kinds(data)[0] == 0, starts, dtype=np.int64) == 0
        for mask, method in ((new & cut & ascii_, self._merged), (new & cut & ~ascii_, self._merged), (new & ~cut, self._encoded)):
            at = np.flatnonzero(mask)
            if len(at):
                fresh = [names[i] for i in at.tolist()]
                numbers[at] = np.arange(len(self.known), len(self.known) + len(at))
                self._add(fresh, *method(fresh))
        return numbers

    def ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of different words, none empty, and the ids."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        data, starts = _bytes(words)
        low, heads = (data, starts) if self.model is None else _cut(data, starts)
        pieces = _strings(low, heads).dictionary_encode()
        which = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        sizes = np.add.reduceat(self.sizes[which], np.searchsorted(heads, starts))
        flat = spread(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, which)
        self._forget()
        return sizes, flat


@lru_cache(1)
def _pieces(path: str) -> _Pieces:
    """One for all tasks of a worker."""
    return _Pieces(path)


class _File:
    """Words of the documents that a file will hold."""

    def __init__(self):
        self.names, self.data, self.lengths, self.bounds, self.words, self.held = [], [], [], [], 0, 0

    def add(self, names: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        inside = ~_BLANK[data]
        starts, ends, bounds = runs(inside, offsets)
        self.names += names
        self.data.append(data[inside])
        self.lengths.append(ends - starts)
        self.bounds.append(bounds[1:] + self.words)
        self.words += len(starts)
        self.held += len(data) + len(names)

    def packed(self, pieces: _Pieces) -> tuple[bytes, int]:
        """The file and its number of ids."""
        lengths = np.concatenate(self.lengths)
        words = _strings(np.concatenate(self.data), np.cumsum(lengths) - lengths).dictionary_encode()
        sizes, flat = pieces.ids(words.dictionary)
        # each text's words and, behind them, the end id as a word
        bounds = np.concatenate(self.bounds)
        which = np.insert(words.indices.to_numpy(), bounds, len(sizes))
        sizes, flat = np.append(sizes, 1), np.append(flat, np.uint32(END_ID))
        ends = np.cumsum(sizes[which])[bounds + np.arange(len(bounds))]
        return pack_words(self.names, np.diff(ends, prepend=0), which, sizes, flat), int(ends[-1])


def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """part, seq, before (ids of the part's earlier files), file of the documents in ascending order of doc_id."""
    path = path or tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        pieces, part, before, seq, file = _pieces(path), TaskContext.get().partitionId(), 0, 0, _File()

        def flush():
            nonlocal before, seq, file
            raw, n = file.packed(pieces)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (raw, pa.binary()))], names=["part", "seq", "before", "file"])
            before, seq, file = before + n, seq + 1, _File()
            return row

        for batch in batches:
            for rows, data, offsets in steps(batch):
                names = rows.column("doc_id").to_pylist()
                at = 0
                while at < len(names):
                    end = int(np.searchsorted(offsets[1:] + np.arange(1, len(names) + 1), int(offsets[at]) + at + FILE_IDS - file.held))
                    end = min(max(end, at) + 1, len(names))
                    file.add(names[at:end], data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                    at = end
                    if file.held >= FILE_IDS:
                        yield flush()
        if file.names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(run, "part int, seq int, before long, file binary"), "ids")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document in the files."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, ids = unpack(batch.column("file")[row].as_py())
                start = batch.column("start")[row].as_py() + np.concatenate(([0], np.cumsum(lengths)))
                for i in range(0, len(doc_ids), 1024):
                    j = min(i + 1024, len(doc_ids))
                    low = int(start[i] - start[0])
                    bounds = (start[i : j + 1] - start[i]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j], pa.int64()), pa.array(start[i:j]), pa.ListArray.from_arrays(bounds, pa.array(ids[low : low + int(bounds[-1])].astype(np.int64)))], names=["doc_id", "start", "ids"])

    return _placed(files).mapInArrow(run, "doc_id long, start long, ids array<long>")


def _placed(files: DataFrame) -> DataFrame:
    """file and the number of ids before it; one number for each part comes to the driver."""

    def size(batches):
        for batch in batches:
            totals = [int(np.frombuffer(f.as_py(), "<u8", 1, TOTAL_AT)[0]) for f in batch.column("file")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(totals, pa.int64())], names=["part", "n"])

    sums = files.select("part", "file").mapInArrow(size, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for r in sums:
        offsets.append((r.part, total))
        total += r.n
    first = files.sparkSession.createDataFrame(offsets, "part int, first long")
    return files.join(F.broadcast(first), "part").select("file", (F.col("first") + F.col("before")).alias("start"))


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, ids = unpack(batch.column("file")[row].as_py())
                at = np.concatenate(([0], np.cumsum(lengths)))
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = batch.column("start")[row].as_py() + at[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_ids(spark, sf_dir: str) -> DataFrame:
    return digest(write(table(spark, sf_dir, "documents")))
