"""Flat files of token ids with 64-bit document offsets, written and read in parallel.

Rows are range-partitioned by document id, so partition ``p`` holds smaller ids than
partition ``p + 1``.  Each partition writes three files into the output folder:

* ``<name>.ids``      unsigned little-endian ids, one document after the other;
* ``<name>.offsets``  unsigned 64-bit offsets (n documents + 1), counted in ids;
* ``<name>.docs``     signed 64-bit document ids.

Ids take 2 bytes when the vocabulary fits and 4 otherwise.  A task writes under a
name of its own attempt and reports it with its counts; only reported files belong to
the data set, so lost or repeated attempts do no harm.  The manifest (one row per
partition) carries each partition's base: the prefix sum of the counts before it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.kernels import column, text_slices
from barloom.llm.pretokens import PieceCache
from barloom.llm.scratch import new_path, on_workers

#: Rows above this many partitions would make the manifest more than a few MB.
MAX_PARTITIONS = 100_000



@dataclass
class _Library:
    """The tokenizers library's tokenizer, a cache of its pieces, and the strings of its added tokens."""

    tokenizer: object
    cache: PieceCache
    added: list[bytes]

    def ids(self, data: np.ndarray, offsets: np.ndarray, match_added: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the offsets between its texts; texts that hold an added token go through the library whole."""
        ids, at = self.cache.ids(data, offsets)
        held = self._holders(data, offsets) if match_added else []
        if not held:
            return ids, at
        parts, size, done = [], np.diff(at), 0
        for t in held:
            own = np.array(self.tokenizer.encode(data[offsets[t] : offsets[t + 1]].tobytes().decode(), add_special_tokens=False).ids, ids.dtype)
            parts += [ids[done : at[t]], own]
            size[t], done = len(own), at[t + 1]
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(size)])

    def _holders(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        raw, found = data.tobytes(), set()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                t = int(np.searchsorted(offsets, at, "right")) - 1
                found.add(t)
                at = raw.find(content, max(at + 1, int(offsets[t + 1]) - len(content) + 1))
        return sorted(found)


_LOADED: dict[str, _Library] = {}


def _visible() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _library(key: str, raw: bytes) -> _Library:
    """Each distinct piece goes through the tokenizers library's model once."""
    if key not in _LOADED:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_buffer(raw)
        tokenize, visible = whole.model.tokenize, _visible()

        def encode(pieces: list[bytes]) -> list[list[int]]:
            return [[t.id for t in tokenize(p.decode("latin-1").translate(visible))] for p in pieces]

        _LOADED.clear()
        _LOADED[key] = _Library(whole, PieceCache(encode), [t.content.encode() for t in whole.get_added_tokens_decoder().values()])
    return _LOADED[key]


def _vocabulary_size(raw: bytes) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(raw).get_vocab_size(with_added_tokens=True)


def _local(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, text: str = "text", key: str = "doc_id", partitions: int | None = None, match_added: bool = True) -> list[dict]:
    """Encode every whole text, append ``end_id`` and write the flat files.

    ``tokenizer`` is a tokenizers JSON file on the driver that splits by the byte-level
    pattern; the strings of its added tokens inside a text become their ids, as in the
    library, or are ordinary text unless ``match_added``.  ``path`` is a folder that all executors reach (by default one below
    ``spark.checkpoint.dir``).  A null text is empty and holds only the end id.
    Documents with equal ids stay beside each other, in no fixed order.  Rows with a
    null id come first.  An empty table gives no files and an empty manifest.  Returns
    the manifest in order: file, docs, ids, base, doc_base, width.
    """
    spark = df.sparkSession
    on_workers(spark)
    path = (path or new_path(spark, "tokens")).rstrip("/")
    with open(tokenizer, "rb") as f:
        raw = f.read()
    name, shipped = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    width = 2 if max(_vocabulary_size(raw), end_id + 1) <= 1 << 16 else 4
    slim = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = slim.repartitionByRange(count, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, kind = _library(name, shipped.value), np.dtype(f"<u{width}")
        store, folder = _local(path)
        store.create_dir(folder, recursive=True)
        file, part, sizes, docs, ids_out = uuid.uuid4().hex, None, [], [], None
        for rows, data, offsets in text_slices(batches, limit=2 << 20):
            if ids_out is None:
                part = column(rows, "part")[0].as_py()
                ids_out = store.open_output_stream(f"{folder}/{file}.ids")
            ids, at = library.ids(data, offsets, match_added)
            n = len(at) - 1
            ids_out.write(np.insert(ids, at[1:], end_id).astype(kind).tobytes())
            sizes.append(np.diff(at) + 1)
            keys = column(rows, "key")
            docs.append(np.asarray(pc.fill_null(keys, np.iinfo(np.int64).min)).astype("<i8"))
            assert n == len(docs[-1])
        if ids_out is None:
            return
        ids_out.close()
        size = np.concatenate(sizes)
        for end, array in (("offsets", np.concatenate([[0], np.cumsum(size)]).astype("<u8")), ("docs", np.concatenate(docs))):
            with store.open_output_stream(f"{folder}/{file}.{end}") as out:
                out.write(array.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{path}/{file}"], "docs": pa.array([len(size)], pa.int64()), "ids": pa.array([int(size.sum())], pa.int64())})

    if count > MAX_PARTITIONS:
        raise ValueError(f"at most {MAX_PARTITIONS} partitions, so that the manifest stays small")
    manifest, base, doc_base = [], 0, 0
    for row in sorted(ordered.mapInArrow(run, "part int, file string, docs long, ids long").collect(), key=lambda r: r.part):
        manifest.append({"file": row.file, "docs": row.docs, "ids": row.ids, "base": base, "doc_base": doc_base, "width": width})
        base, doc_base = base + row.ids, doc_base + row.docs
    return manifest


def _mapped(uri: str, kind: str) -> np.ndarray:
    """Memory-mapped on a mounted file system, fetched whole from any other store."""
    store, path = _local(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """The documents of a data set, in any order: doc_id, start, n_tokens, ids, ids_crc32.

    ``start`` counts the ids of all documents before this one; ``ids_crc32`` is the
    CRC-32 of the ids as little-endian unsigned 32-bit integers; ``ids`` is left out
    unless ``with_ids``.
    """
    on_workers(spark)
    files = spark.createDataFrame([(m["file"], m["base"], m["width"]) for m in manifest], "file string, base long, width int").repartition(max(1, len(manifest)))
    schema = "doc_id long, start long, n_tokens long" + ", ids array<long>" * with_ids + ", ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids, at, docs = _mapped(f"{m['file']}.ids", f"<u{m['width']}"), _mapped(f"{m['file']}.offsets", "<u8").astype(np.int64), _mapped(f"{m['file']}.docs", "<i8")
                for lo in range(0, len(docs), 2000):
                    hi = min(lo + 2000, len(docs))
                    own = [ids[at[i] : at[i + 1]].astype("<u4") for i in range(lo, hi)]
                    keys = np.array(docs[lo:hi])
                    out = {"doc_id": pa.array(keys, mask=keys == np.iinfo(np.int64).min), "start": pa.array(at[lo:hi] + m["base"]), "n_tokens": pa.array(np.diff(at[lo : hi + 1]))}
                    if with_ids:
                        out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    out["ids_crc32"] = pa.array([zlib.crc32(x) for x in own], pa.int64())
                    yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(run, schema)
