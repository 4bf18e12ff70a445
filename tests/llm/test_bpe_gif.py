import base64
import os

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from potluck.llm import bpe as b
from potluck.llm import gif as G
from potluck.llm.common import utf8

from .util import clashing, prose, table

RANKS = [p for p in ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") if os.path.exists(p)]
needs_files = pytest.mark.skipif(not os.path.exists(b.VOCABULARY) or len(RANKS) < 2, reason="no vocabulary files here")
TEXTS = [prose(1, 200), "aaaaaaaa bbbbbb aaaa", "  \n\n\t x  ", "<|endoftext|> 你好 🙂🙂 zz", "it's we'll I'D", "é" * 31, "abcabc" * 40, "", "x"]


def greedy(word, ranks):
    """One word: always the pair of least rank, the leftmost first."""
    parts = [bytes([x]) for x in word]
    while True:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}


def flat(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])]


@needs_files
@pytest.mark.parametrize("path", [b.VOCABULARY, *RANKS])
def test_ids_equal_the_usual_encoder(path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = ranks_of(path if path.endswith("tiktoken") else RANKS[0])
    usual = tiktoken.Encoding(f"x{len(path)}", pat_str=b.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert flat(b.Encoder(path), TEXTS) == [usual.encode_ordinary(t) for t in TEXTS]


@needs_files
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab cé\n", max_size=30), max_size=6))
def test_replay_equals_word_by_word(texts):
    ranks = ranks_of(RANKS[0])
    encoder = b.Encoder(RANKS[0])
    want = [[i for w in regex.findall(b.PATTERN, t) for i in greedy(w.encode(), ranks)] for t in texts]
    assert flat(encoder, texts) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremvldab1éñ２²\u0301\u00a0\u2003\u3000!?.-🙂你"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_words_equal_the_pattern(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    begin, bounds = b.pretokens(data, offsets)
    ends = np.append(begin, len(data))[1:]
    raw = data.tobytes()
    got = [[raw[x:y].decode() for x, y in zip(begin[lo:hi], ends[lo:hi])] for lo, hi in zip(bounds[:-1], bounds[1:])]
    assert got == [regex.findall(b.PATTERN, t) for t in texts]
    which, words, _ = b.distinct_words(data, begin)
    assert [words[i] for i in which] == [raw[x:y] for x, y in zip(begin, ends)] and len(set(words)) == len(words)


def test_every_character_is_of_the_patterns_kind():
    assert [b._kinds()[ord(c)] for c in "aé你1²٣ \n\u3000!\u0301🙂'_"] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 0, 0, 0, 0, 0]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(b, "POSITION", np.zeros(4096, b.U64))  # now words of one length have one hash
    data = np.frombuffer(b"abcdabxy", np.uint8)
    which, words, hashes = b.distinct_words(data, np.array([0, 2, 4, 6]))
    assert [words[i] for i in which] == [b"ab", b"cd", b"ab", b"xy"] and hashes is None


@needs_files
@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_blocks_change_nothing(monkeypatch, size):
    """Over many blocks and with little memory the tokens are those of the usual encoder."""
    tiktoken = pytest.importorskip("tiktoken")
    usual = tiktoken.Encoding("y", pat_str=b.PATTERN, mergeable_ranks=ranks_of(RANKS[0]), special_tokens={})
    texts = [*TEXTS, *(prose(i, 1 + i % 40, 50) + " it's" * (i % 3) for i in range(120)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(b, "BLOCK_BYTES", size)
    monkeypatch.setattr(b, "REMEMBERED", 30)
    rows = [r for p in b._tokenizer(b.VOCABULARY)(iter([batch])) for r in p.to_pylist()]
    assert [(r["doc_id"], r["tokens"], r["exact"]) for r in rows] == [(i, usual.encode_ordinary(t) if t else [], True) for i, t in enumerate(texts)]


@needs_files
def test_a_word_with_the_hash_of_a_known_one(monkeypatch):
    monkeypatch.setattr(b, "POSITION", np.zeros(4096, b.U64))  # words of one length have one hash
    e, once = b.Encoder(), b.Encoder()
    assert flat(e, ["abc"]) == flat(once, ["abc"])
    assert [b.decode(flat(e, [t])[0]) for t in ("xyz", "abc xyz", "abc")] == ["xyz", "abc xyz", "abc"]


@needs_files
def test_exact_is_told_per_text():
    ids, bounds = b.Encoder().encode(["one", "two", "", "three"])
    data, offsets = utf8(pa.array(["one", "twx", "", "three"]))
    assert b.exact_texts(ids, bounds, data, offsets).tolist() == [True, False, True, True]
    data, offsets = utf8(pa.array(["one", "tw", "", "three"]))
    assert b.exact_texts(ids, bounds, data, offsets).tolist() == [True, False, True, True]


@needs_files
@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    ids = flat(b.Encoder(), [text])[0]
    assert b.decode(ids) == text and b.decode_bytes(np.array(ids, dtype=np.int64)).tobytes() == text.encode()


@needs_files
def test_bpe_awkward_rows(spark):
    long = prose(2, 40_000)
    texts = [None, "", long, "same", "same", " ", "🙂"]
    df = clashing(table(spark, texts, ids=[None, 1, 2, 3, 3, 4, 5]), "tokens", "n_tokens", "exact")
    rows = b.tokenize(df).collect()
    got = sorted((r["doc_id"] or 0, b.decode(r["tokens"])) for r in rows)
    assert got == [(0, ""), (1, ""), (2, long), (3, "same"), (3, "same"), (4, " "), (5, "🙂")] and all(r["exact"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in b.detokenize(b.tokenize(df)).collect()}
    assert back[2] == long and back[1] == ""
    assert b.tokenize(df.limit(0)).count() == 0
    nothing = spark.sql("SELECT 1L AS doc_id, CAST(NULL AS ARRAY<INT>) AS tokens")
    assert b.detokenize(nothing).first()["text"] is None


@pytest.mark.parametrize("size", range(2, 9))
@pytest.mark.parametrize("n", [0, 1, 2, 3, 700, 30_000])
def test_lzw_round_trip(size, n):
    rng = np.random.default_rng(n + size)
    for pixels in (rng.integers(0, 1 << size, n), np.zeros(n, int), np.arange(n) % 3):
        p = pixels.astype(np.uint8).tobytes()
        assert G.lzw_decode(G.lzw_encode(p, size), size, n) == p


def plain_lzw(data, min_size, pixels):
    """The textbook decoder with a table of strings."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    bits = "".join(f"{x:08b}"[::-1] for x in data)
    at, size, out, last, table = 0, min_size + 1, b"", None, {}
    while len(out) < pixels and at + size <= len(bits):
        code = int(bits[at : at + size][::-1], 2)
        at += size
        if code == clear:
            table, size, last = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        if code == stop:
            break
        table = table or {i: bytes([i]) for i in range(clear)}
        s = table[code] if code in table else last + last[:1]
        out += s
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + s[:1]
            if len(table) + 2 == 1 << size and size < 12:
                size += 1
        last = s
    return out[:pixels]


def test_lzw_equals_the_textbook_decoder():
    rng = np.random.default_rng(5)
    for size in (2, 4, 8):
        p = (rng.integers(0, 1 << size, 9000) * (rng.random(9000) < 0.3)).astype(np.uint8).tobytes()
        stream = G.lzw_encode(p, size)
        assert plain_lzw(stream, size, 9000) == G.lzw_decode(stream, size, 9000) == p


PALETTE = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]])


def full(v, h=2, w=2):
    return np.full((h, w), v)


def test_disposal_transparency_and_timing():
    data = G.encode(
        2, 2,
        [
            {"index": full(1), "delay": 100},
            {"index": full(2, 1, 1), "x": 1, "y": 1, "delay": 50, "disposal": 3},
            {"index": full(3, 1, 2), "y": 0, "delay": 30, "disposal": 2},
            {"index": np.array([[0, 2], [0, 0]]), "clear": 0, "delay": 10, "palette": PALETTE[::-1]},
        ],
        PALETTE, loops=3,
    )
    w, h, loops, frames = G.decode(data)
    r, g_, bl, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    pixels = [[tuple(int(v) for v in p) for p in f[1].reshape(-1, 4)] for f in frames]
    assert (w, h, loops) == (2, 2, 3) and [(f[0], f[2]) for f in frames] == [(100, "keep"), (50, "previous"), (30, "background"), (10, "keep")]
    assert pixels == [[r] * 4, [r, r, r, g_], [bl, bl, r, r], [none, r, r, r]]  # palette reversed: index 2 is red


def test_interlaced_rows_and_off_screen():
    index = np.arange(16).reshape(16, 1) % 4
    _, _, _, frames = G.decode(G.encode(1, 16, [{"index": index, "interlaced": True}], PALETTE))
    assert frames[0][1][:, 0, :3].tolist() == PALETTE[index[:, 0]].tolist()
    _, _, _, frames = G.decode(G.encode(2, 2, [{"index": full(1, 3, 3), "x": 1, "y": 1}], PALETTE))
    assert (frames[0][1][..., 3] > 0).tolist() == [[False, False], [False, True]]


def test_histogram():
    canvas = np.zeros((1, 3, 4), np.uint8)
    canvas[0, 0] = (255, 0, 0, 255)
    canvas[0, 1] = (0, 0, 64, 255)
    got = G.histogram(canvas)
    assert got.sum() == 2 and got[3 * 16] == 1 and got[1] == 1


def plain_decode(data):
    """A second decoder, pixel by pixel: (width, height, [(delay, {(x, y): RGB})])."""
    width, height = data[6] | data[7] << 8, data[8] | data[9] << 8
    take = lambda at, n: [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
    at, common = 13, None
    if data[10] & 128:
        n = 2 << (data[10] & 7)
        common, at = take(at, n), at + 3 * n
    seen, out, delay, how, clear = {}, [], 0, 0, None
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        label = None
        if kind == 0x21:
            label, at = data[at], at + 1
        else:
            x, y, w, h = (data[at + i] | data[at + i + 1] << 8 for i in (0, 2, 4, 6))
            flags, at = data[at + 8], at + 9
            colours = common
            if flags & 128:
                n = 2 << (flags & 7)
                colours, at = take(at, n), at + 3 * n
            size, at = data[at], at + 1
        body = b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        if label == 0xF9:
            how, delay, clear = body[0] >> 2 & 7, (body[1] | body[2] << 8) * 10, body[3] if body[0] & 1 else None
        if label is not None:
            continue
        symbols, old = plain_lzw(body, size, w * h), dict(seen)
        lines = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)] if flags & 64 else range(h)
        for i, r in enumerate(lines):
            for c in range(w):
                v = symbols[i * w + c]
                if v != clear and v < len(colours) and x + c < width and y + r < height:
                    seen[x + c, y + r] = colours[v]
        out.append((delay, dict(seen)))
        if how == 2:
            seen = {p: v for p, v in seen.items() if not (x <= p[0] < x + w and y <= p[1] < y + h)}
        elif how == 3:
            seen = old
        delay, how, clear = 0, 0, None
    return width, height, out


def random_gif(seed):
    rng = np.random.default_rng(seed)
    frames = []
    for _ in range(int(rng.integers(1, 6))):
        h, w = rng.integers(1, 20, 2)
        f = {"index": rng.integers(0, 5, (h, w)), "x": int(rng.integers(0, 9)), "y": int(rng.integers(0, 9)), "delay": 10 * int(rng.integers(0, 9))}
        f |= {"disposal": int(rng.integers(0, 4)), "clear": int(rng.integers(-1, 4)), "interlaced": bool(rng.integers(0, 2))}
        frames.append(f | ({"palette": rng.integers(0, 256, (5, 3))} if rng.random() < 0.4 else {}))
    return G.encode(16, 12, frames, rng.integers(0, 256, (4, 3)))


def test_whole_files_equal_the_second_decoder():
    for seed in range(60):
        data = random_gif(seed)
        w, h, frames = plain_decode(data)
        got = G.decode(data)
        assert got[:2] == (w, h) and [f[0] for f in got[3]] == [f[0] for f in frames]
        for (_, canvas, _), (_, seen) in zip(got[3], frames):
            want = np.zeros((h, w, 4), int)
            for (x, y), rgb in seen.items():
                want[y, x] = (*rgb, 255)
            assert (canvas == want).all()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 59), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=4), st.integers(0, 500))
def test_damaged_files_are_bad_or_decode(seed, changes, length):
    data = bytearray(random_gif(seed))
    for at, v in changes:
        data[at % len(data)] = v
    try:
        G.decode(bytes(data[: max(20, length)]), 1 << 20)
    except G.BadGif:
        pass


def test_a_huge_screen_is_an_error_row(spark):
    small = G.encode(4, 4, [{"index": full(1, 4, 4)}], PALETTE)
    screen = small[:6] + (60000).to_bytes(2, "little") * 2 + small[10:]
    at = small.index(b"\x2c")
    picture = small[: at + 5] + (60000).to_bytes(2, "little") * 2 + small[at + 9 :]
    df = spark.createDataFrame([(1, screen), (2, picture), (3, small)], "media_id long, gif binary")
    got = {r["media_id"]: r for r in G.decode_frames(df).collect()}
    assert "pixels" in got[1]["error"] and "pixels" in got[2]["error"] and got[3]["error"] is None and len(got) == 3


def test_many_frames_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH_BYTES", 100)
    data = G.encode(4, 4, [{"index": full(i % 4, 4, 4), "delay": 10} for i in range(9)], PALETTE)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([data, data])], names=["media_id", "gif"])
    parts = list(G._decoder(4, 1000)(iter([batch])))
    assert len(parts) > 5 and [(r["media_id"], r["frame"], r["start_ms"]) for p in parts for r in p.to_pylist()] == [(m, i, 10 * i) for m in (1, 2) for i in range(9)]


def test_gif_awkward_rows(spark):
    good = G.encode(2, 2, [{"index": full(1), "delay": 20}, {"index": full(2), "delay": 30}], PALETTE)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, b"no gif at all..."), (6, good[: len(good) - 9]), (None, good), (7, good[:40])]
    df = spark.createDataFrame(rows, "media_id long, gif binary")
    for c in ("frame", "rgba", "error", "width"):
        df = df.selectExpr("*", f"'mine' AS {c}")
    got = G.decode_frames(df).collect()
    frames = {}
    for r in got:
        frames.setdefault(r["media_id"], []).append((r["frame"], r["start_ms"], r["delay_ms"], r["error"] is None))
    assert frames[1] == [(0, 0, 20, True), (1, 20, 30, True)] * 2 and frames[None] == frames[1][:2]
    assert 2 not in frames and all(frames[i] == [(None, None, None, False)] for i in (3, 4, 5, 7)) and frames[6] == frames[1][:1]
    assert all(len(r["rgba"]) == 16 and sum(r["histogram"]) == r["visible"] for r in got if r["error"] is None)
    assert G.decode_frames(df.limit(0)).count() == 0


def test_rendered_texts_decode_to_their_bytes(spark):
    texts = [prose(1, 30), "", None, "é<>" * 3000]
    df = table(spark, texts)
    got = {}
    for r in G.decode_frames(G.render_text(df, "doc_id", "text", 16)).orderBy("frame").collect():
        got.setdefault(r["media_id"], []).append(r)
    assert sorted(got) == [0, 1, 3] and len(got[3]) == -(-len(texts[3].encode()) // 256)
    first = np.frombuffer(got[0][0]["rgba"], np.uint8).reshape(-1, 4)
    assert (first[:, 0] // 32).tolist()[: len(texts[0])] == [x >> 5 for x in texts[0].encode()][:256]
