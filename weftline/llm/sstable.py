"""Token ids as sorted-string tables: shards of documents keyed by identifier.

A shard file is a run of blocks, a sparse index, a Bloom filter and a footer:

* block: entries ``varint shared | varint unshared | varint value size | key suffix | value``, where a key
  shares its first bytes with the key before it (a block's first key is whole), then a CRC-32
* index: first key, offset and size of each block; lookup searches it by halves and reads one block
* Bloom filter: ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` places each
* footer (fixed size): offsets and sizes of index and filter, number of entries and tokens, magic

Keys are eight big-endian bytes with the sign flipped, so byte order is id order; a null id is the empty
key, which comes first. A value is one byte for the width of an id (2 or 4) and the ids, little-endian,
compressed with Zstandard.

Ranges of ids with about equal text become shards, cut from exact sums. Texts are encoded before the one
shuffle, which carries compressed ids; a task sorts its shard's rows by key and writes it as a stream.

Defined cases. Null or empty text: only the end id. Null ``doc_id``: before all others. Repeated ids: each
row is an entry; equal keys are ordered by their ids' bytes, and a lookup returns the first. Other
columns are ignored. Empty table: no files, no rows. Texts are never cut.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import files, textvec
from weftline.llm.common import range_cuts, read, shard_count, shard_of, shared_dir

QUERY = "op3_sstable"
TOKENIZER, END_ID = "byte_bpe_50k.json", 0
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
#: A shard holds about so many characters of text at most.
SHARD_CHARS = 64 << 20
#: A worker forgets its pieces when it holds so many.
CACHE_PIECES = 1_000_000
MAGIC = b"WEFTSST1"
_FOOTER = struct.Struct("<QQQQQQ8s")
_FLIP = 1 << 63

#: A contraction that begins a piece; such texts go to the library whole.
CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    Byte-level pre-tokenization makes pieces that are encoded one by one, so a text's ids are its pieces'
    ids in order. Pieces are found on arrays of code points: runs of letters, numbers or other signs, with
    one blank before; of white space before another piece all but the last; white space at the end. Known
    pieces are kept as sorted hashes with places in one array of ids.
    """

    def __init__(self, path: str, runs):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = textvec.char_kinds(runs) & textvec.KIND
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _library_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are a blank and letters: joined, they are split into themselves again."""
        joined = ["".join(pieces[k : k + 512]) for k in range(0, len(pieces), 512)]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for e in self.tokenizer.encode_batch(joined, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64)))
        counts = np.concatenate(counts)
        if len(counts) != len(pieces) or (counts == 0).any():  # split otherwise: one by one
            return self._library(pieces)
        return np.concatenate(ids), counts

    def encode(self, texts) -> list[np.ndarray]:
        texts = ["" if t is None else t for t in texts]
        whole = [k for k, t in enumerate(texts) if "'" in t and CONTRACTION.search(t) or any(s in t for s in self.specials)]
        out: list = [None] * len(texts)
        flat, counts = self._library([texts[k] for k in whole])
        for k, ids in zip(whole, np.split(flat, np.cumsum(counts)[:-1]) if whole else [], strict=True):
            out[k] = ids
        rest = [k for k in range(len(texts)) if out[k] is None]
        for k, ids in zip(rest, self._by_piece([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self.kinds[points]
        separator = points == textvec.SEPARATOR
        kind[separator] = 4
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        after = np.flatnonzero((kind[1:] > 0) & (kind[1:] < 4) & (kind[:-1] == 0))  # last white space before a piece
        edge[after] = True
        edge[after[points[after] == 32] + 1] = False
        edge[1:][separator] = True
        edge[:-1][separator] = True
        begins = np.flatnonzero(edge)
        begins, ends = begins[:-1], begins[1:]
        real = ~separator[begins] if len(begins) else np.zeros(0, bool)
        return begins[real], ends[real]

    def _learn(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode new pieces and put them among the known."""
        sizes = ends - begins
        text = points[textvec.ragged(begins, sizes)].tobytes().decode("utf-32-le", "surrogatepass")
        bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
        strings = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        plain = (points[begins] == 32) & (sizes > 1) & (self.kinds[points[np.minimum(begins + 1, len(points) - 1)]] == textvec.LETTER)
        for which, encode in ((np.flatnonzero(plain), self._library_words), (np.flatnonzero(~plain), self._library)):
            flat, counts = encode([strings[k] for k in which.tolist()])
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(counts) - counts))
            self.size = np.concatenate((self.size, counts))
            self.keys = np.concatenate((self.keys, keys[which]))
            self.flat = np.concatenate((self.flat, flat))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.size = self.keys[order], self.at[order], self.size[order]

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys among the known, and which are there."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return place, self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _by_piece(self, texts: list[str]):
        points, starts = textvec.code_points(texts)
        begins, ends = self._pieces(points)
        found, first, inverse = np.unique(textvec.span_hashes(points, begins, ends), return_index=True, return_inverse=True)
        place, known = self._known(found)
        if not known.all():
            if len(self.keys) > CACHE_PIECES:
                self._forget()
                known[:] = False
            new = first[~known]
            self._learn(points, begins[new], ends[new], found[~known])
            place, _ = self._known(found)
        place = place[inverse]
        sizes = self.size[place]
        ids = self.flat[textvec.ragged(self.at[place], sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begins, starts)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, runs) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; ``runs``: see :func:`textvec.kind_runs`."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, runs)
    return _ENCODERS[path]


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + _FLIP)


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - _FLIP if key else None


def pack_ids(ids: np.ndarray, compressor) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([width]) + compressor.compress(ids.astype(f"<u{width}").tobytes())


def unpack_ids(value: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(value[1:]), f"<u{value[0]}")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    return [(a + k * b) % (1 << 64) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, given in key order, to a stream."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self.stream, self.block_bytes = stream, block_bytes
        self.offset = self.entries = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.first, self.last = bytearray(), None, b""

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            if key < self.last:
                raise ValueError("keys out of order")
            shared = next((k for k, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += tokens
        if len(self.block) >= self.block_bytes:
            self._end()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        return at, len(data)

    def _end(self) -> None:
        if self.first is not None:
            self.index.append((self.first, *self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))))
            self._begin()

    def finish(self) -> None:
        self._end()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, size) for k, at, size in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at, index_size = self._put(index)
        bloom_at, bloom_size = self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self._put(_FOOTER.pack(index_at, index_size, bloom_at, bloom_size, self.entries, self.tokens, MAGIC))


class Table:
    """A shard's bytes, opened for lookup or for reading in order."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")
        index_at, index_size, self.bloom_at, _, self.entries, self.tokens, magic = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a table file")
        self.bits = struct.unpack("<Q", self.data[self.bloom_at : self.bloom_at + 8])[0]
        self.firsts, self.blocks, at = [], [], index_at
        while at < index_at + index_size:
            n, at = _read_varint(self.data, at)
            self.firsts.append(bytes(self.data[at : at + n]))
            self.blocks.append(struct.unpack("<QQ", self.data[at + n : at + n + 16]))
            at += n + 16

    def may_hold(self, key: bytes) -> bool:
        bloom = self.data[self.bloom_at + 8 :]
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def _entries(self, block: int):
        at, size = self.blocks[block]
        data = self.data[at : at + size - 4]
        if zlib.crc32(data) != struct.unpack("<I", self.data[at + size - 4 : at + size])[0]:
            raise ValueError(f"block {block} is damaged")
        pos, key = 0, b""
        while pos < len(data):
            shared, pos = _read_varint(data, pos)
            unshared, pos = _read_varint(data, pos)
            size, pos = _read_varint(data, pos)
            key = key[:shared] + bytes(data[pos : pos + unshared])
            pos += unshared
            yield key, bytes(data[pos : pos + size])
            pos += size

    def __iter__(self):
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, key: bytes) -> bytes | None:
        """The first value of ``key``: filter, then the index by halves, then one block (or where equal
        keys began in an earlier block, that one)."""
        if not self.firsts or not self.may_hold(key):
            return None
        at = bisect_right(self.firsts, key) - 1
        while at > 0 and self.firsts[at] == key:
            at -= 1
        for block in range(max(0, at), len(self.blocks)):
            if self.firsts[block] > key:
                return None
            for k, value in self._entries(block):
                if k == key:
                    return value
        return None


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; the manifest has a row for each shard.

    Manifest: shard, file, entries, tokens, bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = rows.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) + 64).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    cuts = range_cuts(sized, "doc_id", "size", max(shard_count(spark), -(-total // SHARD_CHARS)))

    runs = textvec.kind_runs()

    def encode(batches):
        enc, pack = encoder(tokenizer, runs), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = [np.concatenate((x, end)) for x in enc.encode(batch.column("text").to_pylist())]
            keys = batch.column("doc_id").to_pylist()
            columns = [
                pa.array([shard_of(cuts, k) for k in keys], pa.int32()),
                pa.array(map(key_bytes, keys), pa.binary()),
                pa.array(map(len, ids), pa.int64()),
                pa.array([pack_ids(x, pack) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "tokens", "value"])

    def store(batches):
        shard, table, stack = None, None, None

        def close():
            nonlocal stack
            table.finish()
            stack.__exit__(None, None, None)
            stack = None
            columns = [[shard], [f"shard-{shard:07d}.sst"], [table.entries], [table.tokens], [table.offset]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "file", "entries", "tokens", "bytes"])

        for batch in batches:
            for s, key, n, value in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "tokens", "value")), strict=True):
                if s != shard:
                    if stack:
                        yield close()
                    shard, stack = s, files.output(folder, f"shard-{s:07d}.sst")
                    table = Writer(stack.__enter__())
                table.add(key, value, n)
        if stack:
            yield close()

    encoded = rows.mapInArrow(encode, "shard int, key binary, tokens long, value binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "value")
    return files.commit(dealt.mapInArrow(store, "shard int, file string, entries long, tokens long, bytes long"), folder)


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry of the committed shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = manifest.select("file", "entries", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def scan(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content, base, entries in zip(batch.column("content"), batch.column("base").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                table = Table(content.as_buffer())
                if table.entries != entries:
                    raise ValueError("a shard differs from its manifest")
                ids, starts, sizes, crcs = [], [], [], []
                for key, value in table:
                    found = unpack_ids(value, unpack)
                    ids.append(key_id(key))
                    starts.append(base)
                    sizes.append(len(found))
                    crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
                    base += len(found)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = files.committed(spark, folder, ".sst", based).select("content", "base", "entries")
    return found.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the asked documents (a short list), by filter, index and one block a shard."""

    def find(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column("content"):
                table = Table(content.as_buffer())
                hits = [(i, unpack_ids(v, unpack).astype(np.int32)) for i in doc_ids if (v := table.get(key_bytes(i))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.committed(spark, folder, ".sst", manifest.select("file")).select("content").mapInArrow(find, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "sstable")
    manifest = write(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    return read_back(spark, folder, manifest)
