"""Byte-level BPE by merge replay over an inverted index.

The different words of a slice of the corpus, but for those a task has met before, form one symbol array. An inverted
index maps every adjacent pair that has a merge to its positions. The merges are applied in rank order,
each to all of its positions at once; only the two neighbours of a merged symbol get new pairs, which
enter the index under their own, later rank.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, POSITION, U64, chunks, env_path, lean, mix, release, utf8

#: Where the vocabulary lies: a merges file (.json) or a rank file (.tiktoken) of a byte-level BPE.
VOCABULARY = env_path("POTLUCK_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts that are cut into words together (a longer text goes alone), and of a slice whose words are replayed together: a merge
#: costs a step however few words it touches, so large slices cost less.
BLOCK_BYTES, SLICE_BYTES = 1 << 19, 8 << 20
#: Words a task remembers with their ids; when it is full it is emptied, which changes no result.
REMEMBERED = 150_000


def _printable() -> dict[str, int]:
    """The usual stand-in characters of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Vocabulary:
    """tokens[id] is its bytes; merge (a, b) -> id has the rank of its place; byte_id[b] is the token of one byte."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        ids = {v: k for k, v in tokens.items()}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        code = np.array([(a << 32) | b for a, b, _ in merges], dtype=np.int64)
        self.left = np.array([a for a, _, _ in merges], dtype=np.int64)
        self.right = np.array([b for _, b, _ in merges], dtype=np.int64)
        self.merged = np.array([c for _, _, c in merges], dtype=np.int64)
        order = np.argsort(code)
        self.codes, self.ranks = code[order], order.astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 if it has none."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)


def _by_ranks(ranks: dict[bytes, int]) -> Vocabulary:
    """Merges of a rank file: every token's last merge is what its bytes become under the earlier ranks."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, where = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    return Vocabulary({v: k for k, v in ranks.items()}, merges)


@cache
def load(path: str = VOCABULARY) -> Vocabulary:
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return _by_ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = _printable()
    special = {t for t in model["vocab"] if not all(c in back for c in t) or t == "<|endoftext|>"}
    tokens = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if t not in special}
    vocab = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Vocabulary(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and the n + 1 bounds of the words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    n = len(raw)
    symbol = vocabulary.byte_id[raw]
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    ends = bounds[1:][bounds[1:] > bounds[:-1]]
    after[ends - 1] = -1
    before[bounds[:-1][bounds[1:] > bounds[:-1]]] = -1
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        rank = vocabulary.rank(symbol[at], symbol[after[at]])
        ok = rank >= 0
        at, rank = at[ok], rank[ok]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        begin = [0, *cuts.tolist()]
        end = [*cuts.tolist(), len(at)]
        for r, lo, hi in zip(rank[begin].tolist(), begin, end):
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heapq.heappush(queue, r)

    enter(np.flatnonzero(after >= 0))
    left, right, merged = vocabulary.left, vocabulary.right, vocabulary.merged
    while queue:
        r = heapq.heappop(queue)
        entries = index.pop(r)
        at = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
        a, b = left[r], right[r]
        nxt = after[at]
        ok = alive[at] & (symbol[at] == a) & (nxt >= 0)
        ok &= symbol[nxt] == b
        at, nxt = at[ok], nxt[ok]
        if not len(at):
            continue
        if a == b and len(at) > 1:
            # in a run such as aaa the left pair goes first: of each chain every other pair
            at = np.unique(at)
            nxt = after[at]
            linked = np.concatenate([[False], at[1:] == nxt[:-1]])
            run = np.cumsum(~linked) - 1
            place = np.arange(len(at)) - np.flatnonzero(~linked)[run]
            at = at[place % 2 == 0]
            nxt = after[at]
        symbol[at] = merged[r]
        alive[nxt] = False
        beyond = after[nxt]
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        touched = np.concatenate([prior[prior >= 0], at[has]])
        if len(touched):
            enter(touched)
    left_over = np.flatnonzero(alive)
    return symbol[left_over], np.searchsorted(left_over, bounds)


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 3 white space, 0 anything else, as the pattern's own library has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            lo, hi = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[lo : hi + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of PATTERN begin in UTF-8 texts (data[offsets[i]:offsets[i + 1]]), and the n + 1 bounds of the texts' words.

    Words are runs of one kind of character. A blank before a word belongs to it, the white space before that is a word, and
    a lone apostrophe takes the ending of a contraction with it.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.cumsum(size) - size
    kind = _kinds()[code]
    # one more place at the end, so that what follows a place can always be asked for; the end counts as a text's beginning
    fresh = np.zeros(n + 3, bool)
    fresh[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
    fresh[n:] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last character of white space before a word of the same text
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~fresh[1:n])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    # a lone apostrophe that begins a word, and the letters after it
    letters = np.concatenate([np.where(kind == 1, code, 0), np.zeros(3, np.uint32)])
    quote = np.flatnonzero((code == 39) & start[:n] & (start[1 : n + 1]) & ~fresh[1 : n + 1])
    one, two = letters[quote + 1], np.where(fresh[quote + 2], 0, letters[quote + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for some, length in ((quote[short], 2), (quote[long], 3)):
        start[some + 1] = False
        start[some + length] = True
    begin = at[np.flatnonzero(start[:n])]
    return begin, np.searchsorted(begin, offsets)


def distinct_words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray | None]:
    """For each word, which begin one after another in data, its place among the different ones, those, and their hashes if no two share one."""
    if not len(begin):
        return np.zeros(0, np.int64), [], np.zeros(0, U64)
    length = np.diff(np.append(begin, len(data)))
    within = np.arange(len(data)) - np.repeat(begin, length)
    parts = (data.astype(U64) + U64(1)) * POSITION[within & 4095]
    h = mix(np.add.reduceat(parts, begin) + length.astype(U64) * GOLDEN)
    hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
    # words with one hash are one word only if their bytes are: all are held against those of the first
    source = np.repeat(begin[first][which], length) + within
    raw = data.tobytes()
    if not ((length == length[first][which]).all() and (data[np.minimum(source, len(data) - 1)] == data).all()):
        ends = begin + length
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(begin.tolist(), ends.tolist())])
        return which, list(place), None
    return which, [raw[a : a + n] for a, n in zip(begin[first].tolist(), length[first].tolist())], hashes


def spread_ids(ids: np.ndarray, begin: np.ndarray, count: np.ndarray, which: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts and the bounds of each: word i is which[i], of which the ids begin at begin[which[i]]; text j has the words words[j]:words[j + 1]."""
    n = count[which]
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], n)
    return ids[at], total[words]


class Encoder:
    """Encodes blocks of texts; keeps the ids of words it has met, by their hashes, within REMEMBERED."""

    def __init__(self, path: str = VOCABULARY):
        self.path, self.vocabulary = path, load(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.count = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _remember(self, hashes: np.ndarray, words: list[bytes], place: np.ndarray) -> None:
        """Encode the words of hashes that are not known; word i is words[place[i]]."""
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != hashes)) if len(self.known) else np.arange(len(hashes))
        if not len(new):
            return
        ids, bounds = replay([words[i] for i in place[new].tolist()], self.vocabulary)
        self.known = np.insert(self.known, at[new], hashes[new])
        self.begin = np.insert(self.begin, at[new], bounds[:-1] + len(self.ids))
        self.count = np.insert(self.count, at[new], np.diff(bounds))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def blocks(self, some: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of texts, a UTF-8 buffer with its offsets, all ids, the n + 1 bounds of the texts and whether the ids of each decode to
        its bytes; the words of all blocks are replayed together."""
        cut = []
        for data, offsets in some:
            begin, words = pretokens(data, offsets)
            which, different, hashes = distinct_words(data, begin)
            cut.append((which.astype(np.int32), words, different, hashes))
        if len(self.known) > REMEMBERED:
            self._forget()
        sound = [(hashes, different) for _, _, different, hashes in cut if hashes is not None]
        if sound:
            every, first = np.unique(np.concatenate([h for h, _ in sound]), return_index=True)
            self._remember(every, list(chain.from_iterable(w for _, w in sound)), first)
        for (data, offsets), (which, words, different, hashes) in zip(some, cut):
            if hashes is not None:
                at = np.searchsorted(self.known, hashes)
                ids, bounds = spread_ids(self.ids, self.begin[at], self.count[at], which, words)
                # a word is known by its hash: that its ids are those of its bytes shows when they are decoded
                exact = exact_texts(ids, bounds, data, offsets, self.path)
                if exact.all():
                    yield ids, bounds, exact
                    continue
            ids, ends = replay(different, self.vocabulary)
            ids, bounds = spread_ids(ids.astype(np.int32), ends[:-1], np.diff(ends), which, words)
            yield ids, bounds, exact_texts(ids, bounds, data, offsets, self.path)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the n + 1 bounds of the texts."""
        return next(self.blocks([utf8(pa.array(texts, pa.string()))]))[:2]


def decode(ids, path: str = VOCABULARY) -> str:
    """The text of some ids; unknown ids raise KeyError. encode followed by decode gives the same text."""
    tokens = load(path).tokens
    return b"".join([tokens[int(i)] for i in ids]).decode("utf-8", errors="replace")


@cache
def _decoding_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = load(path).tokens
    size = max(tokens) + 1
    length = np.zeros(size, np.int64)
    for i, t in tokens.items():
        length[i] = len(t)
    begin = np.cumsum(length) - length
    return np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8), begin, length


def decode_bytes(ids: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """The UTF-8 bytes of many ids at once."""
    data, begin, length = _decoding_table(path)
    n = length[ids]
    out = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[ids], n)
    return data[out]


def exact_texts(ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """For each text whether its ids decode to its bytes."""
    back = decode_bytes(ids, path)
    ends = np.concatenate([[0], np.cumsum(_decoding_table(path)[2][ids])])[bounds]
    if len(back) == len(data) and (ends == offsets).all() and bool((back == data).all()):
        return np.ones(len(offsets) - 1, bool)
    pairs = zip(ends[:-1].tolist(), ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
    return np.array([back[a:b].tobytes() == data[x:y].tobytes() for a, b, x, y in pairs], dtype=bool)


def _tokenizer(path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def encoded() -> Iterator[pa.RecordBatch]:
            for (keys, _, _), (ids, bounds, exact) in zip(held, encoder.blocks([x[1:] for x in held])):
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        pa.array(exact),
                    ],
                    names=["doc_id", "n_tokens", "tokens", "exact"],
                )

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets, BLOCK_BYTES):
                part = offsets[lo : hi + 1]
                # copies, so that the batch can go
                held.append((batch.column(0).slice(lo, hi - lo), data[part[0] : part[-1]].copy(), part - part[0]))
                size += int(part[-1] - part[0])
                if size >= SLICE_BYTES:
                    yield from encoded()
                    held, size = [], 0
                    release()
        if held:
            yield from encoded()

    return tokenize


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact) of every document; exact tells that decoding gives back the text's bytes.

    Ids are those of the usual encoder of the same vocabulary without special tokens. A task
    needs no other task's words, so nothing is shuffled or broadcast at any size.

    A null or empty text has no tokens; a null id stays null; repeated rows are encoded each; a
    text of any length is encoded whole; special-token strings are ordinary text; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(_tokenizer(vocabulary)), "doc_id long, n_tokens long, tokens array<int>, exact boolean"
    )


def _detokenizer(path: str):
    def detokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode(ids, path) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return detokenize


def detokenize(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with token lists; a null list gives a null text, an empty one an empty text."""
    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(
        _detokenizer(vocabulary), "doc_id long, text string"
    )
