"""BPE encoding and decoding by a depth-first walk of a trie of distinct words.

The encoding of a word's prefix ends in one certain token, and what stands before that token is the encoding of the
shorter prefix. So one token a trie node is enough to hold the encodings of all prefixes: the walk goes depth-first
through the trie of the distinct words, in which a shared prefix is one path, and finds each node's last token from those
of the nodes above it. A token t may follow a prefix that ends in u if the merges of the vocabulary, applied to the bytes
of u and t together, never join across the seam.

Texts are cut into words as the byte-level scheme does it (contractions, one leading space, runs of letters, numbers,
others and white space), with array operations over whole batches. The strings of special tokens in a text become those
tokens, as the library does by default. Words are told apart by 64-bit hashes.

Memory a task: pieces of at most `PIECE_BYTES` of text (a longer text alone), and a cache of at most `CACHE_WORDS` words.
The tokenizer file is read once on the driver and sent to the executors (a few MB, whatever the corpus).

Defined results
* null or empty text: no tokens; the digests are those of empty input.
* repeated rows, further columns: each row is encoded on its own; other columns are passed through by name where asked for.
* Empty table: an empty result. Very long words: the work is linear in the word times the vocabulary's token lengths.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, pieces_by_bytes, ragged_index, read_table, span_hashes, text_buffers, with_fields

PIECE_BYTES = 1 << 20
CACHE_WORDS = 1 << 19

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: The code points with the property White_Space.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Contractions that are words of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    letters = {chr(b): b for b in plain}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def _char_classes() -> np.ndarray:
    found = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            found[code] = _LETTER
        elif kind == "N":
            found[code] = _NUMBER
    found[list(WHITE_SPACE)] = _SPACE
    return found


class ByteBpe:
    """A byte-level BPE tokenizer file, read from its bytes."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = _byte_letters()
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {k.encode(): v for k, v in special.items()}
        self.tokens: dict[int, bytes] = {v: bytes(letters[c] for c in k) for k, v in model["vocab"].items() if k not in special}
        self.ids = {v: k for k, v in self.tokens.items()}
        self.tokens |= {v: k for k, v in self.special.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank of the merge
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.merge_rank[a, b] = rank
            self.made_of[vocab[left + right]] = (a, b, rank)
        lengths: dict[int, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        n = max(self.tokens) + 1
        sizes = np.array([len(self.tokens.get(i, b"")) for i in range(n)], np.int64)
        self.token_sizes, self.token_starts = sizes, np.cumsum(sizes) - sizes
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(n)), np.uint8)
        self.classes = _char_classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.word_starts, self.word_counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    # -- the trie walk -----------------------------------------------------------------------------------------------

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that touch its left (0) or right (1) end at some time, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.edges:
            found, until = [], float("inf")
            while True:
                found.append((token, until))
                if token not in self.made_of:
                    break
                until = self.made_of[token][2]
                token = self.made_of[token][side]
            self.edges[key] = found
        return self.edges[key]

    def _seam_holds(self, u: int, t: int) -> bool:
        """Whether the bytes of u and t, merged together, give exactly u and t."""
        key = (u, t)
        held = self.seams.get(key)
        if held is None:
            ranks = self.merge_rank
            held = True
            for a, a_until in self._edge(u, 1):
                for b, b_until in self._edge(t, 0):
                    r = ranks.get((a, b))
                    # At equal rank the leftmost pair is merged first: a's own merge lies left of the seam, b's right of it.
                    if r is not None and r < a_until and r <= b_until:
                        held = False
            if len(self.seams) > 4_000_000:
                self.seams.clear()
            self.seams[key] = held
        return held

    def walk(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words. In sorted order neighbours share exactly the trie path to their common prefix, and the
        stack `last` holds the last token of each node on the present path."""
        out: list[list[int]] = [[]] * len(words)
        ids, lengths, holds = self.ids, self.lengths, self._seam_holds
        last: list[int] = [-1]
        path = b""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for n in lengths[word[depth - 1]]:
                    if n <= depth:
                        t = ids.get(word[depth - n : depth])
                        if t is not None and (n == depth or holds(last[depth - n], t)):
                            last.append(t)
                            break
            path = word
            found, depth = [], len(word)
            while depth:
                found.append(last[depth])
                depth -= len(self.tokens[last[depth]])
            out[at] = found[::-1]
        return out

    # -- cutting texts into words ------------------------------------------------------------------------------------

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bytes of all words, characters' first bytes are implied) for texts that lie end to end in `data`; bounds: where each begins, and the end."""
        ascii_only = not len(data) or data.max() < 0x80
        if ascii_only:
            codes, at_byte = data, None
        else:
            codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(codes)
        kind = self.classes[codes]
        first = np.zeros(n + 1, bool)
        edge = np.unique(bounds if at_byte is None else np.searchsorted(at_byte, bounds))
        first[edge] = True
        text_start = first.copy()
        text_start[n] = True
        kind_next = np.append(kind[1:], _OTHER)
        kind_before = np.append(np.uint8(_OTHER), kind[:-1])
        space, ends = kind == _SPACE, text_start[1:]
        leads = np.zeros(n, bool)  # a blank that goes with the word after it
        lone_end = space & ~ends & (kind_next != _SPACE)  # the last of a run of white space, before a word of the same text
        leads = lone_end & (codes == 0x20)
        led = np.append(False, leads[:-1])
        before_text = text_start[:n]
        begins = np.where(space, before_text | (kind_before != _SPACE) | lone_end, before_text | ((kind != kind_before) & ~led))
        quote = np.flatnonzero((codes == 0x27) & begins & ~ends & (kind_next == _LETTER))
        if len(quote):
            padded = np.append(codes, [0, 0, 0]).astype(np.uint32)
            closed = np.append(text_start, [True, True, True])
            for part in CONTRACTIONS:
                ok = np.ones(len(quote), bool)
                for k, letter in enumerate(part, 1):
                    ok &= (padded[quote + k] == ord(letter)) & ~closed[quote + k]
                hit, quote = quote[ok], quote[~ok]
                begins[hit + 1] = False
                after = hit + 1 + len(part)
                after = after[(after < n)]
                begins[after[kind[after] == _LETTER]] = True
        chars = np.flatnonzero(begins)
        return chars if at_byte is None else at_byte[chars]

    # -- whole texts -------------------------------------------------------------------------------------------------

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words in the cache, which gets those that are new."""
        hashes = span_hashes(data, starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._forget()
        known = self.known
        number = np.array([known.get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist())]
            found = self.walk(words)
            counts = np.array([len(x) for x in found], np.int64)
            flat = np.array([t for x in found for t in x], np.uint32)
            base = len(known)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while base + len(fresh) > len(self.word_starts):
                self.word_starts, self.word_counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word_starts, self.word_counts))
            self.flat[self.used : self.used + len(flat)] = flat
            self.word_starts[base : base + len(fresh)] = self.used + np.cumsum(counts) - counts
            self.word_counts[base : base + len(fresh)] = counts
            self.used += len(flat)
            number[fresh] = base + np.arange(len(fresh))
            known.update(zip(distinct[fresh].tolist(), number[fresh].tolist()))
        return number[back.reshape(-1)]

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids a text) for texts without special tokens."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        starts = self.cut(data, bounds)
        ends = np.append(starts[1:], len(data))
        number = self._words(data, starts, ends)
        counts = self.word_counts[number]
        ids = self.flat[ragged_index(self.word_starts[number], counts)]
        running = np.concatenate([[0], np.cumsum(counts)])
        cuts = running[np.searchsorted(starts, bounds)]
        return ids, np.diff(cuts)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids a text)."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return self._plain(data, bounds)
        import re

        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        keep, segment_bounds, text_of, marks = [], [0], [], []
        for row in range(len(bounds) - 1):
            a, b = int(bounds[row]), int(bounds[row + 1])
            while True:
                m = pattern.search(raw, a, b)
                end = m.start() if m else b
                keep.append(raw[a:end])
                segment_bounds.append(segment_bounds[-1] + end - a)
                text_of.append(row)
                marks.append(self.special[m[0]] if m else -1)
                if not m:
                    break
                a = m.end()
        ids, counts = self._plain(np.frombuffer(b"".join(keep), np.uint8), np.array(segment_bounds, np.int64))
        at = np.cumsum(counts)
        marks, text_of = np.array(marks), np.array(text_of)
        ids = np.insert(ids, at[marks >= 0], marks[marks >= 0].astype(np.uint32))
        per_text = np.bincount(text_of, weights=counts + (marks >= 0), minlength=len(bounds) - 1).astype(np.int64)
        return ids, per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids as UTF-8; broken sequences become U+FFFD."""
        sizes = self.token_sizes[ids]
        raw = self.token_bytes[ragged_index(self.token_starts[ids], sizes)].tobytes()
        running = np.concatenate([[0], np.cumsum(sizes)])
        cuts = running[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:])]


_loaded: dict[str, ByteBpe] = {}


def _tokenizer(raw: bytes) -> ByteBpe:
    """One tokenizer a worker process and file; the last few are kept."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(raw)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256, and where asked for the ids and the decoded text."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    with open(path or default_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    extra = ([("ids", "array<int>")] if with_ids else []) + ([("decoded", "string")] if with_text else [])
    names = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *extra]
    schema = with_fields(kept.schema, ", ".join(f"{name} {kind}" for name, kind in names))

    def run(batches):
        bpe = _tokenizer(sent.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(keep)))
            for first, last in pieces_by_bytes(offsets, PIECE_BYTES):
                a, b = offsets[first], offsets[last]
                ids, counts = bpe.encode(data[a:b], offsets[first : last + 1] - a)
                texts = bpe.decode(ids, counts)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                raw, at = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
                columns = [batch.column(i).slice(first, last - first) for i in range(len(keep))]
                columns += [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:])], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *[x for x, _ in names]])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), with_ids=False)
