"""Token ids in binary files with a shared zstandard dictionary.

Every document is encoded, its ids are serialised as little-endian numbers of the
smallest width that holds the vocabulary, and compressed on its own with a dictionary
trained on the serialised ids of a bounded sample of documents.  A short document
compresses well that way and is read without the rest of its file.

A file ``part-<bucket>-<n>.ids`` holds documents in ascending order of id:

    magic "QIDS1\\0\\0\\0" | header length, u32 | header, JSON: width, documents, ids,
    start (ids of the bucket before the file), dictionary hash | index | frames

The index has, per document, id (i64), offset of its frame behind the index (u64), ids
(u32) and whether the id is null (u32); one more offset closes it.  The dictionary
itself is ``dictionary-<hash>.zdict`` in the same folder.

Buckets are ranges of ids, cut at quantiles of all ids, so a task sorts and writes one
range, whatever the sources are; a bucket's files follow each other in order.
"""

from __future__ import annotations

import array
import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import new_folder, release, write_file

MAGIC = b"QIDS1\0\0\0"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4"), ("null", "<u4")])
END_ID = 0
# The dictionary learns from so many documents at most, and so many bytes of each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2_000, 8_192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
FILE_BYTES = 8 << 20  # a file is closed beyond this
BUCKET_TEXT_BYTES = 64 << 20
PIECES_HELD = 150_000  # encoded pieces that a worker remembers, in each of two generations
ROWS_AT_ONCE = 300
TEXT_AT_ONCE = 4 << 20  # characters; a longer text is alone
# White space before which a text cannot be cut at a space without changing its pieces.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
# Words of letters, each with a full stop or comma at most, between single spaces or line ends.
_PROSE = r"\A\pL+[.,]?(?:[ \n]\pL+[.,]?)*\z"
# Letters, digits and marks of which every version of Unicode says the same.  In pieces of
# these the vocabulary's pattern parts runs of one kind, a space before belonging to them,
# and single line ends.  An apostrophe may start a contraction and is none of them.
_LETTERS, _MARKS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F", r"!-&(-/:-@\[-`{-~"
_RUN = rf"\A ?[{_LETTERS}]+\z"
_PLAIN = rf"\A ?[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*\z"
_RUNS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
_CODE_POINTS = 0x180  # beyond the last of them


class Remembered(dict):
    """Two generations of ids by piece: the younger fills up, then takes the older's place."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def found(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of each piece and the places of those that neither generation knows; those of the older are taken over."""
        out, new = list(map(self.get, pieces)), []
        for k, ids in enumerate(out):
            if ids is None:
                piece = pieces[k]
                ids = self.older.get(piece)
                if ids is None:
                    new.append(k)
                else:
                    self[piece] = out[k] = ids
        return out, new

    def age(self) -> None:
        """Between texts only, when nothing is being looked up."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class Encoder:
    """A tokenizer whose ids for the space-separated pieces of texts are remembered.

    The vocabulary is byte-level BPE: its pieces never reach across a space that
    follows and is followed by something else, so the ids of a text are those of
    its pieces, each with the space before it.  Plain prose is cut further, into
    letters, full stops or commas, and line ends, which the vocabulary's pattern keeps
    apart as well; there are fewer different ones.  Texts with other white space around
    spaces, or with a string that the vocabulary treats specially, are encoded whole.

    A new piece of Latin letters, digits and ASCII marks is parted here as the pattern
    would, and its runs go straight to the tokenizer's model, which spares most of the
    time of a whole encoding.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        config = json.loads(self.tokenizer.to_str())
        kind = (config.get("pre_tokenizer") or {}).get("type")
        self.by_piece = kind == "ByteLevel" and config.get("normalizer") is None and not config["pre_tokenizer"].get("add_prefix_space")
        self.by_run = self.by_piece and not self.special_within() and config["pre_tokenizer"].get("use_regex", True)
        self.model, self.bytes = self.tokenizer.model, {}
        if self.by_run:
            # The vocabulary's signs for bytes, as the tokenizer itself writes them.
            for code in range(1, _CODE_POINTS):
                signs = "".join(run for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(code)))
                self.bytes.update(zip(chr(code).encode(), signs, strict=True))
        self.pieces = Remembered(PIECES_HELD)

    def special_within(self) -> bool:
        """Whether a string that is treated specially could stand in a piece of a text that is cut."""
        return any(t.normalized or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())

    def _serial(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        found, places = self.pieces.found(pieces)
        new = [pieces[k] for k in places]
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            for place, piece, ids in zip(places[k : k + 10_000], some, self._encoded(some), strict=True):
                found[place] = self.pieces[piece] = ids
        self.pieces.age()
        return found

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Serialised ids of pieces that are not remembered."""
        out: list[bytes] = [b""] * len(pieces)
        one, more, rest = [], [], range(len(pieces))
        if self.by_run:
            kinds = [pc.match_substring_regex(pa.array(pieces), form).to_numpy(zero_copy_only=False) for form in (_RUN, _PLAIN)]
            one, more, rest = (np.flatnonzero(x).tolist() for x in (kinds[0], kinds[1] & ~kinds[0], ~kinds[1]))
        for places, parts in ((one, None), (more, _RUNS)):
            if places:
                for k, ids in zip(places, self._by_run([pieces[k] for k in places], parts), strict=True):
                    out[k] = ids
        if len(rest):
            for k, encoding in zip(rest, self.tokenizer.encode_batch([pieces[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = self._serial(encoding.ids)
        return out

    def _by_run(self, pieces: list[str], parts: re.Pattern | None) -> list[bytes]:
        """Serialised ids of plain pieces; the model gives those of each run."""
        signs = "\0".join(pieces).encode().decode("latin-1").translate(self.bytes).split("\0")
        tokenize, ids, ends = self.model.tokenize, array.array(self.code), []
        for piece, signed in zip(pieces, signs, strict=True):
            at = 0
            for run in parts.findall(piece) if parts else ():
                end = at + len(run.encode())
                ids.extend([t.id for t in tokenize(signed[at:end])])
                at = end
            if not parts:
                ids.extend([t.id for t in tokenize(signed)])
            ends.append(len(ids) * ids.itemsize)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _together(self, texts: list[str], prose: bool) -> list[bytes]:
        """Ids of texts that can be cut: each different piece is looked up once."""
        cut = pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 ")
        for mark in (".", ",") if prose else ():
            cut = pc.replace_substring(cut, mark, "\0" + mark)
        if prose:
            cut = pc.replace_substring(cut, "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        data, first = np.frombuffer(b"".join(found), self.kind), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        n = sizes[place]
        ends = np.cumsum(n)
        ids = data[np.arange(n.sum()) - np.repeat(ends - n - first[place], n)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of each text, without an end."""
        out: list[bytes] = [b""] * len(texts)
        prose, other = [], []
        plain = pc.match_substring_regex(pa.array(texts, pa.large_string()), _PROSE).to_pylist()
        for k, text in enumerate(texts):
            if self.by_piece and plain[k]:
                prose.append(k)
            elif not self.by_piece or "\0" in text or _UNSAFE.search(text) or (self.special and self.special.search(text)):
                out[k] = self._serial(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                other.append(k)
        for group, is_prose in ((prose, True), (other, False)):
            if group:
                for k, ids in zip(group, self._together([texts[k] for k in group], is_prose), strict=True):
                    out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, kept from task to task."""
    kept = sys.modules.setdefault("_token_store_encoders", types.ModuleType("_token_store_encoders"))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return getattr(kept, path)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of some rows at a time, so that a task holds few texts as strings."""
    first = 0
    sizes = pc.binary_length(batch.column(column)).to_numpy()
    while first < batch.num_rows:
        reach = np.cumsum(sizes[first : first + ROWS_AT_ONCE])
        n = max(1, int(np.searchsorted(reach, TEXT_AT_ONCE)))
        yield first, batch.column(column).slice(first, n).to_pylist()
        release()
        first += n


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def train_dictionary(rows: DataFrame, vocabulary: str, total: int) -> bytes:
    """A dictionary for serialised ids, from a bounded sample chosen by hash; empty if there is too little."""
    chance = min(1.0, SAMPLE_DOCUMENTS / max(1, total))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for _, texts in _slices(batch, 1):
                found = [ids[:SAMPLE_BYTES] for ids in encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in drawn.mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCUMENTS).collect())
    samples = [s for s in samples if s]
    room = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 8 or room < 1024:
        return b""
    try:
        return zstandard.train_dictionary(room, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too much alike
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return f"{zlib.crc32(dictionary):08x}{len(dictionary):08x}"


def _file(entries: list[tuple], frames: list[bytes], kind: np.dtype, start: int, dictionary: bytes) -> list[bytes]:
    offsets = np.cumsum([0, *map(len, frames)])
    index = np.zeros(len(entries) + 1, ENTRY)
    for k, (doc_id, ids) in enumerate(entries):
        index[k] = (doc_id or 0, 0, ids, doc_id is None)
    index["offset"] = offsets
    header = json.dumps(
        {
            "width": kind.itemsize,
            "documents": len(entries),
            "ids": sum(n for _, n in entries),
            "start": start,
            "dictionary": dictionary_hash(dictionary),
        },
        sort_keys=True,
    ).encode()
    return [MAGIC, struct.pack("<I", len(header)), header, index.tobytes(), *frames]


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Write the ids of all documents below ``folder``; the written files, one row each.

    Returns ``bucket, n, path, documents, ids`` as a table kept in the folder.  A null
    text counts as empty and has the end id only.  Null ids come first; rows of one id
    stand in order of their ids' bytes.  Repeated rows are written as often as they
    come.  An empty table gives a folder with a dictionary and no file.
    """
    spark = docs.sparkSession
    rows = _rows(docs, doc_id, text)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    dictionary = train_dictionary(rows, vocabulary, size["n"])
    # The mark keeps an empty dictionary from being an empty file, which readers pass over.
    write_file(f"{folder}/dictionary-{dictionary_hash(dictionary)}.zdict", [MAGIC, dictionary])
    wanted = max(1, (size["bytes"] or 0) // BUCKET_TEXT_BYTES, min(spark.sparkContext.defaultParallelism, size["n"]))
    shares = [k / wanted for k in range(1, wanted)]
    # Bounds from the ids of all documents; the texts are not read for this.
    bounds = sorted(set(rows.approxQuantile("doc_id", shares, 0.1 / wanted))) if shares and size["n"] else []
    shared = spark.sparkContext.broadcast((dictionary, np.array([int(b) for b in bounds], np.int64)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary)
        dictionary, bounds = shared.value
        packer = _compressor(dictionary)
        end = np.array([end_id], encode_texts.kind).tobytes()
        for batch in batches:
            for first, texts in _slices(batch, 1):
                ids = batch.column(0).slice(first, len(texts))
                bucket = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
                data = [d + end for d in encode_texts(texts)]
                counts = [len(d) // encode_texts.kind.itemsize for d in data]
                frames = [packer.compress(d) for d in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), ids, pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                    ["bucket", "doc_id", "ids", "frame"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(vocabulary).kind
        dictionary, _ = shared.value
        entries, frames, held, done, bucket, n, start = [], [], 0, [], None, 0, 0

        def close() -> None:
            nonlocal entries, frames, held, n, start
            if entries:
                path, ids = f"{folder}/part-{bucket:08d}-{n:06d}.ids", sum(k for _, k in entries)
                write_file(path, _file(entries, frames, kind, start, dictionary))
                done.append((bucket, n, path, len(entries), ids))
                entries, frames, held, n, start = [], [], 0, n + 1, start + ids

        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            for at, doc_id, ids, frame in zip(*columns, strict=True):
                if at != bucket:
                    close()
                    bucket, n, start = at, 0, 0
                elif held > FILE_BYTES:
                    close()
                entries.append((doc_id, ids))
                frames.append(frame)
                held += len(frame)
        close()
        made = list(zip(*done, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)], ["bucket", "n", "path", "documents", "ids"]
        )

    encoded = rows.mapInArrow(encode, "bucket int, doc_id long, ids long, frame binary")
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids", "frame")
    files = ordered.mapInArrow(write, "bucket int, n int, path string, documents long, ids long")
    files.write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Frames without checksum; their size is in the frame."""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class Reader:
    """A file's documents, each decompressed on its own."""

    def __init__(self, content: bytes, dictionary: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        (size,) = struct.unpack_from("<I", content, 8)
        self.header = json.loads(content[12 : 12 + size])
        if self.header["dictionary"] != dictionary_hash(dictionary):
            raise ValueError(f"the file needs dictionary {self.header['dictionary']}")
        self.kind = np.dtype(f"<u{self.header['width']}")
        self.index = np.frombuffer(content, ENTRY, self.header["documents"] + 1, 12 + size)
        self.content, self.base = content, 12 + size + self.index.nbytes
        self.unpack = _decompressor(dictionary)

    def __len__(self) -> int:
        return self.header["documents"]

    def doc_id(self, k: int) -> int | None:
        return None if self.index["null"][k] else int(self.index["doc_id"][k])

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        a, b = self.base + int(self.index["offset"][k]), self.base + int(self.index["offset"][k + 1])
        return np.frombuffer(self.unpack.decompress(self.content[a:b]), self.kind)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of this id; binary search in the index."""
        first = int(self.index["null"][: len(self)].sum())
        known = self.index["doc_id"][first : len(self)]
        a, b = np.searchsorted(known, doc_id, "left"), np.searchsorted(known, doc_id, "right")
        return [self.ids(first + k) for k in range(a, b)]


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(f"{folder}/dictionary-*.zdict").select("content").first()[0])[len(MAGIC) :]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the folder, from its files.

    ``start`` counts the ids of all documents before it.  The files' headers carry what
    is before them in their bucket; only a sum per bucket passes the driver.
    """
    files = spark.read.parquet(f"{folder}/files")
    sums = {r["bucket"]: r["ids"] for r in files.groupBy("bucket").agg(F.sum("ids").alias("ids")).collect()}
    before = dict(zip(sorted(sums), np.cumsum([0, *(sums[b] for b in sorted(sums))]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((read_dictionary(spark, folder), before))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, before = shared.value
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(content.as_buffer().to_pybytes(), dictionary)
                counts = reader.index["ids"][: len(reader)].astype(np.int64)
                start = before[int(path.rsplit("part-", 1)[1].split("-")[0])] + reader.header["start"]
                starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(reader) else counts
                sums = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader))]
                keys = pa.array([reader.doc_id(k) for k in range(len(reader))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(starts, pa.int64()), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    if not sums:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").load(f"{folder}/part-*.ids").select("path", "content")
    return content.mapInArrow(run, schema)


def default_vocabulary() -> str:
    """The public byte-level vocabulary, wherever it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_store")
def op5(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, default_vocabulary())
    return read_tokens(spark, folder)
