"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of records in ascending order of the id. Each is framed as

    length of the payload, 8 bytes | checksum of those 8 bytes, 4 | payload | checksum of the payload, 4

all little-endian; a checksum is the CRC-32 of the bytes, rotated right by 15 bits plus 0xA282EAD8 (masked, so that a record
which itself holds checksums is not at odds with its own). The payload is 1 byte (1 if there is an id), the id in 8 bytes,
1 byte for the width of a token (2 or 4), then the tokens. Beside each file its index has, for each record, the offset of
its frame and its number of tokens, 8 bytes each, so records can be read in any order.

Encoding: the tokenizer's words never reach over a single space or line break between visible characters, so texts are cut
there, words met before come from a bounded cache, and the library encodes the others, many at a time; texts with other
white space or one of its special strings are encoded whole. Tests hold the ids against the library's for whole texts.

Defined results: a null text counts as empty; an empty text is the end id alone. Rows without an id come first; rows of one
id are in order of text. No rows: no rows. Files are written by the tasks to the shared folder under names of their own and
then renamed, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import new_folder, partitions, range_buckets

#: Pieces that a worker remembers.
CACHE = 1_200_000
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The payload at the stream's place, or None at its end."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    length = struct.unpack("<Q", head[:8])[0]
    payload, tail = stream.read(length), stream.read(4)
    if len(payload) < length or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("a record is damaged")
    return payload


def payload_of(doc_id: int | None, tokens: bytes, width: int) -> bytes:
    return struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + tokens


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from("<BqB", payload)
    return doc_id if known else None, np.frombuffer(payload, dtype="<u2" if width == 2 else "<u4", offset=10)


def _kept() -> types.ModuleType:
    """What outlives a task in its worker process."""
    return sys.modules.setdefault("_lakepipe_token_cache", types.ModuleType("_lakepipe_token_cache"))


class Encoder:
    """Texts to the bytes of their ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.splits = self._splits()
        if self.splits:
            self.line = self._one("\n")[0]
            self.stops = {c: np.array(self._one(c), dtype=self.kind).tobytes() for c in ".,"}

    def _splits(self) -> bool:
        """Whether this is a byte-level tokenizer that may be cut before spaces and around single line breaks."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        return level and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and len(self._one("\n")) == 1

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """Words; all but the first and those that start with their line break stand for themselves with a space before.

        None for texts that may not be cut so: with white space next to white space, at the ends, or with special strings.
        """
        if not self.splits or any(s in text for s in self.special):
            return None
        if text.replace("\n", " ") != " ".join(text.split()):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, new: list[str]) -> None:
        """Puts pieces into the cache: a word and the stop after it are encoded apart, as the tokenizer does."""
        cache, stopped, spaced, broken = self.cache, {}, {}, {}
        for p in new:
            if p[-1] in ".," and (stem := p[:-1]).removeprefix("\n").isalpha():
                stopped[p] = stem
                if stem in cache:
                    continue
                p = stem
            (broken if p[0] == "\n" else spaced)[p] = None
        line = np.array([self.line], dtype=self.kind).tobytes()
        self._put(list(spaced), [" " + p for p in spaced], b"")
        self._put(list(broken), [p[1:] for p in broken], line)
        for p, stem in stopped.items():
            cache[p] = cache[stem] + self.stops[p[-1]]

    def _put(self, keys: list[str], words: list[str], before: bytes) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            # one text for all, with a line break (a token of its own) after each
            ids = np.array(self._many("\n".join(part)), dtype=self.kind)
            ends = np.flatnonzero(ids == self.line) * self.width
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer does not keep line breaks apart")
            raw, stops = ids.tobytes(), ends.tolist()
            found = [raw[a:b] for a, b in zip([0, *(ends + self.width).tolist()], [*stops, len(ids) * self.width], strict=True)]
            self.cache.update(zip(keys[at : at + 4096], [before + f for f in found] if before else found, strict=True))

    def _many(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        whole = [i for i, c in enumerate(cut) if c is None]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        # the first word has no space before it, like one after a line break
        found = [["\n" + c[0], *c[1:]] if c else None for c in cut]
        wanted = set().union(*[c for c in found if c])
        if len(self.cache) > CACHE:
            self.cache.clear()
        # what this batch needs, apart from the rest, stays in the processor's caches
        here = dict(zip(wanted, map(self.cache.get, wanted)))
        if new := [p for p, v in here.items() if v is None]:
            self._learn(new)
            here.update(zip(new, map(self.cache.__getitem__, new)))
        get, skip = here.__getitem__, self.width
        for i, c in enumerate(found):
            if c is not None:
                out[i] = b"".join(map(get, c))[skip:]
        return out


def encoder(path: str) -> Encoder:
    kept = _kept()
    if getattr(kept, "path", None) != path:
        kept.encoder, kept.path = Encoder(path), path
    return kept.encoder


def _filesystem(uri: str):
    """What Arrow opens the folder with, from Spark's name for it. Arrow has local, HDFS, S3, GCS and Azure stores."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    uri = f"{ {'s3a': 's3', 's3n': 's3', 'abfs': 'abfss', 'wasbs': 'abfss'}.get(scheme, scheme)}://{rest}" if colon else uri
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"records cannot be written to {scheme}://; give a folder in a local, HDFS, S3, GCS or Azure store") from e


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> list[dict]:
    """Writes the files; gives, in order, for each: part, path, records, tokens.

    Ids are dealt to ranges, so files follow each other in order of the id, and a task writes a range as it comes.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    n = parts or partitions(spark)
    bucket = range_buckets(docs, F.col(doc_id).cast("long"), n)
    rows = docs.select(bucket.alias("bucket"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        coder, end = encoder(tokenizer), None
        end = np.array([end_id], dtype=coder.kind).tobytes()
        out = index = path = None
        part = offset = records = tokens = 0
        mark = uuid.uuid4().hex
        for b in batches:
            buckets, ids = b.column("bucket").to_numpy(), b.column("doc_id").to_pylist()
            for at in range(0, b.num_rows, 256):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    part = int(buckets[0])
                    path = f"{base}/part-{part:06d}"
                    out, index = fs.open_output_stream(f"{path}.{mark}"), fs.open_output_stream(f"{path}.index.{mark}")
                lines = coder.encode(b.column("text").slice(at, 256).to_pylist())
                for i, raw in zip(ids[at : at + 256], lines, strict=True):
                    framed = frame(payload_of(i, raw + end, coder.width))
                    count = len(raw) // coder.width + 1
                    out.write(framed)
                    index.write(struct.pack("<QQ", offset, count))
                    offset += len(framed)
                    records += 1
                    tokens += count
        if out is not None:
            out.close()
            index.close()
            fs.move(f"{path}.{mark}", f"{path}.records")
            fs.move(f"{path}.index.{mark}", f"{path}.index")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "records": [records], "tokens": [tokens]})

    made = rows.mapInArrow(run, "part int, path string, records long, tokens long").collect()
    return sorted((r.asDict() for r in made), key=lambda r: r["part"])


def read(spark, files: list[dict], columns: str = "start long, n_tokens long, ids_crc32 long", of=None) -> DataFrame:
    """Every record of the files of write(), read one after the other and checked: doc_id and ``columns``.

    ``of``: a function of (ids, number of tokens before) that gives the columns' values.
    """
    of = of or (lambda ids, start: (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    base, rows = 0, []
    for f in files:
        rows.append((f["path"], base, f["records"]))
        base += f["tokens"]
    schema = f"doc_id long, {columns}"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, base long, records long").repartition(len(rows))
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, records in zip(*(b.column(c).to_pylist() for c in ("path", "base", "records")), strict=True):
                fs, at = _filesystem(path)
                ids, found = [], []

                def batch():
                    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x[c] for x in found]) for c in range(len(names)))], names=["doc_id", *names])

                n = 0
                with fs.open_input_stream(f"{at}.records", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, tokens = parse(payload)
                        ids.append(doc_id)
                        found.append(of(tokens, start))
                        start += len(tokens)
                        n += 1
                        if len(ids) == 4096:
                            yield batch()
                            ids, found = [], []
                if n != records:
                    raise ValueError(f"{path}: {n} records, not {records}")
                if ids:
                    yield batch()

    return listed.mapInArrow(run, schema)


def read_at(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records with those numbers of one file, by its index, in the order asked for."""
    fs, at = _filesystem(path)
    with fs.open_input_file(f"{at}.index") as index, fs.open_input_file(f"{at}.records") as records:
        found = []
        for i in numbers:
            index.seek(16 * i)
            offset, _ = struct.unpack("<QQ", index.read(16))
            records.seek(offset)
            found.append(parse(read_frame(records)))
    return found
