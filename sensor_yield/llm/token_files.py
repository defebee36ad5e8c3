"""Token ids in binary files: one shared zstandard dictionary, one frame per document.

Documents are ordered by id over range partitions; each partition writes one file:

    header   magic, SHA-256 of the dictionary, bytes per id (2 or 4)
    frames   one zstandard frame per document: its ids, little-endian, end id included
    index    ids of the documents, null marks, frame offsets, token counts
    trailer  offset of the index, number of documents and of tokens, magic

A reader needs the trailer, the index and the named dictionary to fetch any one document.
The dictionary is trained on the serialized ids of slices of ``SAMPLE_CHARS`` characters from ``sample_docs``
documents of any length, picked by hash: a bounded sample that concerns compression only.

Ids are computed once per distinct run of characters between ASCII white space in a block of texts, which
gives the tokenizer's own ids wherever no token spans white space; ``encoder`` refuses tokenizers
outside that family, told by their normalizer and pre-tokenizer.

Defined cases: null text is empty (one token, the end id); a null id comes first and is read
back as null; documents that share an id are ordered by a hash of their text; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.llm.common import arrow_rows, process_cache, scratch, task_count
from sensor_yield.llm.files import AtomicWriter, RangeReader, resolve, text_bytes

MAGIC = b"IDSZD001"
HEADER, HEADER_BYTES = "<8s32sB", 41
TRAILER, TRAILER_BYTES = "<QQQ8s", 32
DICTIONARY_BYTES = 32 << 10
SAMPLE_CHARS = 8192
SPAN_BYTES = 4 << 20
#: Remembered pieces of each kind per Python process, and their greatest length.
MEMORY_RUNS, MEMORY_BYTES = 100_000, 64
#: Signs that may follow a word: with a letter or digit before them they are a piece of their own.
TAIL = ".,;:!?#$%&*"
#: Letters before this one have one form and simple lower case.
LATIN = "\u0250"
#: A word of such letters, and the signs after it. Letters count here whose lower case Arrow and Python agree on.
WORDS = "^(?P<core>[{}]+)(?P<tail>[{}]*)$".format("".join(
    c for c in map(chr, range(ord(LATIN))) if c.isalpha() and [c.lower()] == pc.utf8_lower(pa.array([c])).to_pylist()), TAIL)
#: Bytes of text encoded at once, and where longer texts may be cut.
BLOCK_BYTES, BLANK = 8 << 20, re.compile(rb"\s")


def blocks(rows: Iterable, size: Callable) -> Iterator[list]:
    """Neighbouring rows of together about ``BLOCK_BYTES``, by the size of each."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += size(row)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def at_blanks(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``BLOCK_BYTES``, cut at white space."""
    at = 0
    while len(text) - at > BLOCK_BYTES and (blank := BLANK.search(text, at + BLOCK_BYTES)):
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def encoder(tokenizer_path: str) -> tuple[Callable[[list[bytes]], list[bytes]], int]:
    """A function from texts (UTF-8) to serialized ids, and the bytes per id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    with open(tokenizer_path, encoding="utf-8") as f:
        said = json.load(f)
    steps = json.dumps([said["normalizer"], said["pre_tokenizer"]])
    by_run = '"Regex": "\\\\s+"' in steps and "^\\\\s" in steps and '"behavior": "Removed"' in steps
    held = process_cache().setdefault(("encoder", tokenizer_path), {})
    if not held:
        rename = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        held.update(tokenizer=Tokenizer.from_file(tokenizer_path), runs={}, others={}, cores={},
                    names={c: rename(chr(c))[0][0] for c in range(128, ord(LATIN))})
    tokenizer = held["tokenizer"]
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    tokenize = tokenizer.model.tokenize

    def plain(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    def of_letters(words: list[str]) -> list[bytes]:
        # lower-case Latin letters are one piece, of which only the bytes are renamed
        pieces = [[t.id for t in tokenize(w if w.isascii() else w.translate(held["names"]))] for w in words]
        raw = np.fromiter(chain.from_iterable(pieces), kind).tobytes()
        ends = [kind.itemsize * n for n in accumulate(map(len, pieces), initial=0)]
        return [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def of_run(text: str) -> bytes:
        if "<" in text:  # special tokens begin so, and are told from their letters' case
            return plain(text)
        text = text.lower() if text.isascii() or max(text, default="") < LATIN else text
        core = text.rstrip(TAIL)
        if core and core[-1].lower()[-1].isalnum():  # signs after a letter or digit are a piece of their own
            return remembered("runs", [core], of_pieces)[0] + remembered("runs", [text[len(core):]], of_pieces)[0]
        return plain(text)

    def of_pieces(texts: list[str]) -> list[bytes]:
        return [plain(x) for x in texts]

    def remembered(name: str, texts: list[str], of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        known = held[name]
        ids = [known.get(x) for x in texts]
        missing = [i for i, x in enumerate(ids) if x is None]
        new = [texts[i] for i in missing]
        for i, text, found in zip(missing, new, of(new), strict=True):
            ids[i] = found
            if len(text) <= MEMORY_BYTES:  # unbroken text (Chinese, base64, minified code) is not remembered
                known[text] = found
        if len(known) > MEMORY_RUNS:
            held[name] = {}
        return ids

    def gather(pieces: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in this order, one after the other, and where each ends."""
        sizes = np.array([len(x) for x in pieces], np.int64) // kind.itemsize
        counts = sizes[order]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[order] - ends + counts
        return np.frombuffer(b"".join(pieces), kind)[np.repeat(shift, counts) + np.arange(counts.sum())], ends

    def of_block(texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = split.values.dictionary_encode()
        runs = words.dictionary
        # a run is a word of Latin letters with signs after it, or else something else as a whole
        told = pc.extract_regex(runs, WORDS)
        core, tail = (column.dictionary_encode() for column in told.flatten())
        other = np.flatnonzero(told.is_null())
        lower = pc.utf8_lower(core.dictionary).dictionary_encode()
        pieces = [*remembered("cores", lower.dictionary.to_pylist(), of_letters),
                  *remembered("runs", tail.dictionary.to_pylist(), of_pieces),
                  *remembered("others", runs.take(pa.array(other)).to_pylist(), lambda x: [of_run(y) for y in x]), b""]
        n_core, n_tail = len(lower.dictionary), len(tail.dictionary)
        order = np.full((len(runs), 2), len(pieces) - 1)
        simple = np.flatnonzero(told.is_valid())
        order[simple, 0] = lower.indices.to_numpy()[core.indices.drop_null().to_numpy()]
        order[simple, 1] = tail.indices.drop_null().to_numpy() + n_core
        order[other, 0] = np.arange(len(other)) + n_core + n_tail
        flat, ends = gather(pieces, order.ravel())
        cuts = np.append(0, ends[1::2] * kind.itemsize).tolist()
        raw = flat.tobytes()
        flat, ends = gather([raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])], words.indices.to_numpy())
        cuts = (np.append(0, ends)[split.offsets.to_numpy()] * kind.itemsize).tolist()
        raw = flat.tobytes()
        return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def by_runs(texts: list[bytes]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        pieces = [(i, piece) for i, text in enumerate(texts) for piece in at_blanks(text)]
        for block in blocks(pieces, lambda x: len(x[1])):
            for (i, _), ids in zip(block, of_block([piece for _, piece in block]), strict=True):
                out[i].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    return by_runs if by_run else lambda texts: [plain(t.decode()) for t in texts], kind.itemsize


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, sample_docs: int = 512) -> bytes:
    """The shared dictionary, trained in one task on slices of a bounded sample of documents."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer_path)
        end = end_id.to_bytes(width, "little")
        samples = [x + end for b in batches for x in encode(text_bytes(b.column("text")))]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
            data = b"".join(samples)[-DICTIONARY_BYTES:].ljust(64, b"\0")
        yield pa.RecordBatch.from_pydict({"data": [data]})

    # picked by the hash of the id alone, so the first scan reads no texts; then a slice from anywhere in the text:
    # documents of every length teach the dictionary, in bounded memory
    pick = F.xxhash64("doc_id")
    cut = docs.select(pick.alias("pick")).orderBy("pick").limit(sample_docs).agg(F.max("pick")).first()[0]
    last = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    piece = F.substring("text", (F.pmod(F.xxhash64("text"), last) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    sample = docs.where(pick <= F.lit(cut).cast("bigint")).select(piece.alias("text")).limit(sample_docs)
    found = sample.coalesce(1).mapInArrow(train, "data binary").first()
    return bytes(found[0]) if found else b"\0" * 64


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text). Returns the list of files in document order:
    path, at (position in the order), n_docs, n_tokens, n_bytes."""
    spark = docs.sparkSession
    arrow_rows(spark)
    data = train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(data).digest()
    fs, root = resolve(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{digest.hex()}.dictionary", compression=None) as out:
        out.write(data)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, nulls, sizes, counts = None, [], [], [], []
        rows = (row for batch in batches
                for row in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True))
        for block in blocks(rows, lambda row: len(row[1])):
            if out is None:
                context = TaskContext.get()
                path = f"{folder}/ids-{context.partitionId():06d}.bin"
                out = AtomicWriter(path, context.taskAttemptId())
                encode, width = encoder(tokenizer_path)
                end = end_id.to_bytes(width, "little")
                pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data))
                out.write(struct.pack(HEADER, MAGIC, digest, width))
            for (doc_id, _), plain in zip(block, encode([text for _, text in block]), strict=True):
                plain += end
                frame = pack.compress(plain)
                out.write(frame)
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                sizes.append(len(frame))
                counts.append(len(plain) // width)
        if out is None:
            return
        at = out.tell()
        for values, kind in ((ids, "<i8"), (nulls, "u1"), (sizes, "<u8"), (counts, "<u8")):
            out.write(np.array(values, kind).tobytes())
        out.write(struct.pack(TRAILER, at, len(ids), sum(counts), MAGIC))
        out.commit()
        yield pa.RecordBatch.from_pydict({"path": [path], "at": [context.partitionId()], "n_docs": [len(ids)],
                                          "n_tokens": [sum(counts)], "n_bytes": [out.size]})

    schema = "path string, at bigint, n_docs bigint, n_tokens bigint, n_bytes bigint"
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").drop("tie"))
    listing = f"{folder}/files.parquet"
    ordered.mapInArrow(write, schema).write.parquet(listing)
    return spark.read.schema(schema).parquet(listing)


def file_index(reader: RangeReader) -> tuple[bytes, int, dict[str, np.ndarray]]:
    """Dictionary digest, bytes per id and the index of one file: doc_id, null, begin, size
    (of the frame) and count (tokens)."""
    at, n_docs, _, magic = struct.unpack(TRAILER, reader.read(reader.size - TRAILER_BYTES, TRAILER_BYTES))
    head, digest, width = struct.unpack(HEADER, reader.read(0, HEADER_BYTES))
    if magic != MAGIC or head != MAGIC:
        raise ValueError("not a file of token ids")
    raw, index, pos = reader.read(at, 25 * n_docs), {}, 0
    for name, kind in (("doc_id", "<i8"), ("null", "u1"), ("size", "<u8"), ("count", "<u8")):
        index[name] = np.frombuffer(raw, kind, n_docs, pos)
        pos += index[name].nbytes
    index["begin"] = HEADER_BYTES + np.concatenate([[0], np.cumsum(index["size"].astype("<i8"))[:-1]]).astype("<i8")
    return digest, width, index


def unpacker(folder: str, digest: bytes) -> zstandard.ZstdDecompressor:
    """A decompressor with the dictionary a file names, checked against its digest."""
    reader = RangeReader(f"{folder}/{digest.hex()}.dictionary")
    data = reader.read(0, reader.size)
    reader.close()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary does not have the digest the file names")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data))


def read_document(folder: str, path: str, number: int) -> np.ndarray:
    """The ids of one document of a file, from its index entry and its frame alone."""
    reader = RangeReader(path)
    digest, width, index = file_index(reader)
    frame = reader.read(int(index["begin"][number]), int(index["size"][number]))
    reader.close()
    return np.frombuffer(unpacker(folder, digest).decompress(frame), f"<u{width}").astype("<u4")


def read_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the listed files: doc_id, start (tokens before it), n_tokens,
    ids_crc32 (of its ids as 32-bit little-endian) and, on request, ids."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                reader = RangeReader(path)
                _, _, index = file_index(reader)
                reader.close()
                before = first + np.concatenate([[0], np.cumsum(index["count"].astype("<i8"))[:-1]])
                cut = np.flatnonzero(np.diff(index["begin"] // SPAN_BYTES, prepend=-1))
                stops = np.append(cut[1:], len(before))
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(cut), "lo": cut.astype("<i8"), "hi": stops.astype("<i8"),
                    "first": before[cut].astype("<i8")})

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                reader = RangeReader(span["path"])
                digest, width, index = file_index(reader)
                unpack, rows, start = unpacker(folder, digest), [], span["first"]
                lo, hi = span["lo"], span["hi"]
                at = int(index["begin"][lo])
                block = reader.read(at, int(index["begin"][hi - 1] + index["size"][hi - 1]) - at)
                reader.close()
                for i in range(lo, hi):
                    begin = int(index["begin"][i]) - at
                    ids = np.frombuffer(unpack.decompress(block[begin:begin + int(index["size"][i])]),
                                        f"<u{width}").astype("<u4")
                    if len(ids) != index["count"][i]:
                        raise ValueError(f"{span['path']}: document {i} does not have the tokens its index names")
                    rows.append((None if index["null"][i] else int(index["doc_id"][i]), start, len(ids),
                                 zlib.crc32(ids.tobytes()), ids))
                    start += len(ids)
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r[4].astype("<i8") for r in rows], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("first"))
    spans = placed.repartition(task_count(files.count()), "path").mapInArrow(
        locate, "path string, lo bigint, hi bigint, first bigint")
    # by bytes: the rows that name the spans are tiny, and Spark would put them all in one task
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    return spans.repartition(task_count(total // SPAN_BYTES + 1), "path", "lo").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
               text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode ``docs`` into files and return what is read back from them."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    folder = folder or scratch(docs.sparkSession, "ids")
    return read_files(write_files(docs, folder, tokenizer_path, end_id), folder)
