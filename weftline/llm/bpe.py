"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-pair encoding keeps, for each prefix of a word, one last token: the token that ends the encoding of
that prefix. So a word is encoded from left to right. At each position an automaton over the vocabulary
(nodes of a trie with links to the longest proper suffix that is also a node) names all tokens that end
there; the one token stays whose pair with the last token of the prefix before it is compatible, that is,
no merge across their border would have come before the merges that made the two. Its length is stored for
the prefix; following these back from the end of the word gives the ids, and they are the ones that merging
in rank order gives.

Texts are split into words as arrays of code points (see :mod:`weftline.llm.textvec`). The distinct words of a
batch are encoded side by side, one symbol of all of them a step; a text's ids are gathered from its words'.
A worker keeps the vocabulary and a bounded table of pairs that were tested, and nothing else between batches.

Defined cases. Null or empty text: no ids, empty decoded text. Null ``doc_id`` and repeated rows: each row
gets its own result. Strings of special tokens in a text become their ids, as in the library. Other columns
are ignored. Empty table: no rows. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import textvec
from weftline.llm.common import read

QUERY = "op6_bpe"
TOKENIZER = "word_bpe_49k.json"
#: A worker forgets its tested pairs of tokens when it holds so many (24 bytes each, at most 48 while the table grows).
CACHE_PAIRS = 1_000_000
#: Longer words are encoded one by one: few are that long, and steps are shared by all words of a batch.
LONG_WORD = 64

#: Words of their own by the tokenizer file; otherwise it splits into letters, single numbers and other signs.
CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
_INF = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and the suffix automaton of one tokenizer file, as flat arrays.

    A symbol is a byte, or 256 and more for a byte that ends its word (it carries the end-of-word mark).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.last_symbol = 256 if mark else 0
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[int, int] = {}
        #: of tokens that merges make: rank of the merge, its left part, its right part
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            self.rank[ids[a] << 20 | ids[b]] = k
            self.made.setdefault(ids[a + b], (k, ids[a], ids[b]))
        self._automaton([(self._symbols(t, mark), i) for t, i in ids.items()])
        names = [b""] * (1 + max(*ids.values(), *self.specials.values(), 0))
        for token, i in (ids | self.specials).items():
            names[i] = b" " + token.encode()
        self.name_size = np.fromiter(map(len, names), np.int64, len(names))
        self.name_at = np.cumsum(self.name_size) - self.name_size
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self._forget_pairs()

    def _symbols(self, token: str, mark: str) -> list[int]:
        """A token as symbols; empty for one that is not spelled in the byte alphabet."""
        ends = bool(mark) and token.endswith(mark) and len(token) > len(mark)
        body = token[: -len(mark)] if ends else token
        found = [self.byte_of.get(c, -1) for c in body]
        if -1 in found or not found:
            return []
        return [*found[:-1], found[-1] + 256] if ends else found

    def _automaton(self, tokens: list[tuple[list[int], int]]) -> None:
        """Trie over the symbols of the tokens that merges can make, with suffix links.

        ``token[node]`` is the token that the node spells (-1: none), ``depth`` its symbols, and ``shorter``
        the node of the longest proper suffix that is a token (0: none).
        """
        step: dict[int, int] = {}
        depth, token_at, parents = [0], [-1], [(0, 0)]
        for symbols, i in tokens:
            if not symbols or len(symbols) > 1 and i not in self.made:
                continue
            node = 0
            for s in symbols:
                child = step.get(node << 9 | s)
                if child is None:
                    child = step[node << 9 | s] = len(depth)
                    depth.append(depth[node] + 1)
                    token_at.append(-1)
                    parents.append((node, s))
                node = child
            token_at[node] = i
        suffix, shorter = [0] * len(depth), [0] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            parent, s = parents[node]
            back = suffix[parent]
            while back and back << 9 | s not in step:
                back = suffix[back]
            suffix[node] = step.get(back << 9 | s, 0) if parent else 0
            shorter[node] = suffix[node] if token_at[suffix[node]] >= 0 else shorter[suffix[node]]
        self.step = textvec.IntTable(20)
        self.step.put(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))
        self.suffix, self.shorter, self.depth, self.token = (np.array(x, np.int64) for x in (suffix, shorter, depth, token_at))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined characters are merged in rank order.

        While both are being made, the parts that touch the border change: on the left the chain of right
        parts, on the right the chain of left parts. A merge of two touching parts happens if its rank comes
        before both merges that take them up; of equal ranks the leftmost place goes first.
        """
        lefts, rights = [(left, _INF)], [(right, _INF)]
        while lefts[-1][0] in self.made:
            k, _, part = self.made[lefts[-1][0]]
            lefts.append((part, k))
        while rights[-1][0] in self.made:
            k, part, _ = self.made[rights[-1][0]]
            rights.append((part, k))
        a, b = len(lefts) - 1, len(rights) - 1
        while True:
            (x, x_until), (y, y_until) = lefts[a], rights[b]
            across = self.rank.get(x << 20 | y, _INF)
            if across < x_until and across <= y_until and across < _INF:
                return False
            if x_until == _INF and y_until == _INF:
                return True
            if x_until <= y_until:
                a -= 1
            else:
                b -= 1

    def _forget_pairs(self) -> None:
        self.pairs = textvec.IntTable(20)

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs; each new pair is tested once while the table holds it."""
        keys = left << 20 | right
        apart = self.pairs.get(keys)
        unknown = np.flatnonzero(apart < 0)
        if len(unknown):
            new, inverse = np.unique(keys[unknown], return_inverse=True)
            if self.pairs.size > CACHE_PAIRS:
                self._forget_pairs()
            found = np.fromiter((self.compatible(k >> 20, k & 0xFFFFF) for k in new.tolist()), np.int32, len(new))
            if len(new) < CACHE_PAIRS:
                self.pairs.put(new, found)
            apart[unknown] = found[inverse]
        return apart > 0

    def _next(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The automaton's state after one more symbol, of many words."""
        out, live = np.zeros_like(node), np.arange(len(node))
        while len(live):
            to = self.step.get(node << 9 | symbol)
            known = to >= 0
            out[live[known]] = to[known]
            more = ~known & (node > 0)
            live, node, symbol = live[more], self.suffix[node[more]], symbol[more]
        return out

    def encode_words(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (their symbols one after the other), and how many each has; words are not empty."""
        begin = np.cumsum(sizes) - sizes
        last, length, count = (np.zeros(len(symbols), np.int64) for _ in range(3))
        order = np.argsort(-sizes, kind="stable")
        by_size, starts = sizes[order], begin[order]
        node = np.zeros(len(sizes), np.int64)
        for n in range(int(by_size[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-by_size, -n, "left"))  # words with more than n symbols
            here = starts[:live]
            node = self._next(node[:live], symbols[here + n])
            end = np.where(self.token[node] >= 0, node, self.shorter[node])
            open_ = np.arange(live)
            while len(open_):
                if not end.all():
                    raise ValueError("no token ends at a symbol: the vocabulary lacks it")
                token, size, at = self.token[end], self.depth[end], here[open_] + n
                fits = size == n + 1
                rest = np.flatnonzero(~fits)
                fits[rest] = self.all_compatible(last[at[rest] - size[rest]], token[rest])
                done = at[fits]
                last[done], length[done] = token[fits], size[fits]
                count[done] = 1 + np.where(size[fits] > n, 0, count[np.maximum(done - size[fits], 0)])
                open_, end = open_[~fits], self.shorter[end[~fits]]
        totals = count[begin + sizes - 1] if len(sizes) else count
        out, left = np.zeros(int(totals.sum()), np.uint32), sizes.copy()
        put, live = np.cumsum(totals) - 1, np.arange(len(sizes))
        while len(live):
            at = begin[live] + left[live] - 1
            out[put[live]] = last[at]
            put[live] -= 1
            left[live] -= length[at]
            live = live[left[live] > 0]
        return out, totals

    def encode_long(self, symbols: list[int]) -> list[int]:
        """Ids of one word, symbol by symbol."""
        last, length, node = [], [], 0
        for n, s in enumerate(symbols, 1):
            node = int(self._next(np.array([node]), np.array([s]))[0])
            end = node if self.token[node] >= 0 else int(self.shorter[node])
            while end:
                token, size = int(self.token[end]), int(self.depth[end])
                if size == n or self.all_compatible(np.array([last[n - size - 1]]), np.array([token]))[0]:
                    last.append(token)
                    length.append(size)
                    break
                end = int(self.shorter[end])
            else:
                raise ValueError("no token ends at a symbol: the vocabulary lacks it")
        out, n = [], len(symbols)
        while n:
            out.append(last[n - 1])
            n -= length[n - 1]
        return out[::-1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes, in one array, and how many each has; an empty word has none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        full = sizes > 0
        symbols[(begin + sizes - 1)[full]] += self.last_symbol
        short = full & (sizes <= LONG_WORD)
        ids, some = self.encode_words(symbols[textvec.ragged(begin[short], sizes[short])], sizes[short])
        counts = np.zeros(len(words), np.int64)
        counts[short] = some
        long = {k: self.encode_long(symbols[begin[k] : begin[k] + sizes[k]].tolist()) for k in np.flatnonzero(full & ~short).tolist()}
        for k, found in long.items():
            counts[k] = len(found)
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        out[textvec.ragged(at[short], some)] = ids
        for k, found in long.items():
            out[at[k] : at[k] + len(found)] = found
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, each with a space before it: the tokenizer file names no decoder."""
        return self.name_bytes[textvec.ragged(self.name_at[ids], self.name_size[ids])]


def normalise(text: str) -> str:
    """NFC, white space to one blank, lower case of each character by itself."""
    text = unicodedata.normalize("NFC", text)
    return regex.sub(r"\s+", " ", text).replace("Σ", "σ").lower()


class Encoder:
    """Encodes batches of texts with one vocabulary."""

    def __init__(self, path: str, runs):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab = Vocabulary(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocab.specials)) + ")") if self.vocab.specials else None
        self.classes = textvec.char_kinds(runs)

    def _slow(self, text: str) -> tuple[np.ndarray, bytes]:
        """One text split by the library: where contractions, special tokens or unfamiliar letters occur."""
        byte_of, found = self.vocab.byte_of, [np.zeros(0, np.uint32)]
        for part in self.special.split(text) if self.special else [text]:
            if part in self.vocab.specials:
                found.append(np.array([self.vocab.specials[part]], np.uint32))
            else:
                words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
                found.append(self.vocab.encode([bytes([byte_of[c] for c in word]) for word, _ in words])[0])
        ids = np.concatenate(found)
        return ids, self.vocab.decode(ids)[1:].tobytes()

    def encode(self, texts) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decoded UTF-8) of each text."""
        out: list = [None] * len(texts)
        plain, at = [], []
        for k, text in enumerate(texts):
            text = text or ""
            if self.special and self.special.search(text):
                out[k] = self._slow(text)
                continue
            normal = text.lower() if text.isascii() else normalise(text)
            if "'" in normal and CONTRACTION.search(normal):
                out[k] = self._slow(text)
            else:
                plain.append(normal)
                at.append(k)
        points, starts = textvec.code_points(plain)
        kind = self.classes[points]
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind & textvec.UNFAMILIAR), "right") - 1)
        for k, found in zip(at, self._fast(points, starts, kind & textvec.KIND), strict=True):
            out[k] = found
        for k in odd.tolist():
            out[at[k]] = self._slow(texts[at[k]])
        return out

    def _fast(self, points: np.ndarray, starts: np.ndarray, kind: np.ndarray):
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins = np.flatnonzero(edge)
        begins, ends = begins[:-1], begins[1:]
        full = kind[begins] > 0 if len(begins) else np.zeros(0, bool)
        begins, ends = begins[full], ends[full]
        keys = textvec.span_hashes(points, begins, ends)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        flat, sizes = self.vocab.encode(self._bytes(points, begins[first], ends[first]))
        offsets = np.cumsum(sizes) - sizes
        ids = flat[textvec.ragged(offsets[inverse], sizes[inverse])]
        bounds = np.concatenate(([0], np.cumsum(sizes[inverse])))
        word_bounds = np.searchsorted(begins, starts)
        spelled = self.vocab.decode(flat)
        cuts = np.concatenate(([0], np.cumsum(self.vocab.name_size[flat])))[np.append(offsets, len(flat))]
        spelled, cuts = spelled.tobytes(), cuts.tolist()
        texts_of = [spelled[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        order = inverse.tolist()
        for k in range(len(starts) - 1):
            a, b = word_bounds[k], word_bounds[k + 1]
            yield ids[bounds[a] : bounds[b]], b"".join([texts_of[w] for w in order[a:b]])[1:]

    @staticmethod
    def _bytes(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of the words ``points[begin:end]``."""
        sizes = ends - begins
        text = points[textvec.ragged(begins, sizes)].tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.cumsum(sizes).tolist()
        return [text[a:b].encode("utf-8", "replace") for a, b in zip([0, *cuts], cuts, strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, runs) -> Encoder:
    """The worker's encoder for a tokenizer file; ``runs``: see :func:`textvec.kind_runs`."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, runs)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document."""

    runs = textvec.kind_runs()

    def run(batches):
        enc = encoder(path, runs)
        for batch in batches:
            found = enc.encode(batch.column("text").to_pylist())
            ids = pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids, pa.array([x[1].decode() for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, without sending either to the JVM."""

    runs = textvec.kind_runs()

    def run(batches):
        enc = encoder(path, runs)
        for batch in batches:
            found = enc.encode(batch.column("text").to_pylist())
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(i) for i, _ in found], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i, _ in found], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
