"""MPEG columns, HTML text, token counts and byte-level BPE: round trips, libraries, brute force."""

from __future__ import annotations

import os
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from verdica.llm import bpe, html, mpeg, queries, transducer

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_mpeg_round_trip(data):
    stored = mpeg.encode(data)
    s = mpeg.read(stored)
    whole = mpeg.padded(data)
    assert mpeg.payload(stored, s) == whole and whole[: len(data)] == data and len(whole) % 576 == 0 and whole
    assert s.table_frames == len(s.offsets) == len(whole) // 576 and not s.damaged and not s.resynced
    assert s.duration == Fraction(len(whole), 16000) and s.tags["TXXX"] == f"bytes\0{len(data)}"
    assert all(stored[o : o + 4] == mpeg.HEADER for o in s.offsets)


def frame(version: int, layer: int, kbit_index: int, rate_index: int, padding: int = 0, checked: bool = False) -> bytes:
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not checked), kbit_index << 4 | rate_index << 2 | padding << 1, 0xC0))
    h = mpeg.header(head)
    side = bytes(h.side_bytes)
    body = (struct.pack(">H", mpeg.checksum(head[2:] + side)) if checked else b"") + side
    return head + body + bytes(h.size - 4 - len(body))


@pytest.mark.parametrize(
    ("head", "widths", "channels", "bound"),
    [
        ("fffe80c0", [4] * 32, 1, 32),  # MPEG-1 Layer I, 256 kbit/s, 44.1 kHz, mono
        ("fffe8050", [4] * 32, 2, 8),  # the same in joint stereo, bound 8
        ("fffca000", [4] * 11 + [3] * 12 + [2] * 7, 2, 32),  # MPEG-1 Layer II, 192 kbit/s, 44.1 kHz, stereo
        ("fffc8460", [4] * 11 + [3] * 12 + [2] * 4, 2, 12),  # 128 kbit/s, 48 kHz, joint stereo, bound 12
        ("fffc28c0", [4] * 2 + [3] * 10, 1, 32),  # 48 kbit/s, 32 kHz, mono
        ("fff484c0", [4] * 4 + [3] * 7 + [2] * 19, 1, 32),  # MPEG-2 Layer II, mono
    ],
)
def test_mpeg_checksums_of_layers_one_and_two(head, widths, channels, bound):
    head, rng = bytes.fromhex(head), random.Random(8)
    h = mpeg.header(head)
    bits, chosen = "", 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = rng.randrange(1 << width)
            bits += f"{value:0{width}b}"
            chosen += (channels if band >= bound else 1) if value and h.layer == 2 else 0
    bits += "".join(rng.choice("01") for _ in range(2 * chosen))
    crc = 0xFFFF
    for bit in f"{int.from_bytes(head[2:], 'big'):016b}{bits}":
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
    body = int(bits.ljust(8 * (h.size - 6), "0"), 2).to_bytes(h.size - 6, "big")
    good = head[:1] + bytes([head[1] & 0xFE]) + head[2:] + struct.pack(">H", crc) + body
    flip = lambda bit: (int.from_bytes(good, "big") ^ (1 << (8 * h.size - 49 - bit))).to_bytes(h.size, "big")
    s = mpeg.read(good * 2 + flip(len(bits) - 1) + flip(len(bits)) + good)
    assert (len(s.headers), s.checked, s.damaged) == (5, 5, 1)


def test_mpeg_variable_bitrate_resync_and_damage():
    frames = [frame(3, 3, 9, 0), frame(3, 3, 5, 0, 1), frame(3, 3, 14, 0, checked=True), frame(3, 3, 2, 0, checked=True)]
    s = mpeg.read(b"".join(frames))
    assert len(s.headers) == 4 and len({h.kbits for h in s.headers}) == 4 and s.duration == Fraction(4 * 1152, 44100) and s.checked == 2 and not s.damaged
    garbage = b"\xff\xfb\x90garbage\xff\xff\xff"
    s = mpeg.read(frames[0] + frames[1] + garbage + frames[2] + frames[3])
    assert len(s.headers) == 4 and s.resynced == 1 and s.skipped == len(garbage)
    assert s.offsets[2] == len(frames[0] + frames[1] + garbage)
    hurt = bytearray(frames[2])
    hurt[8] ^= 1
    assert mpeg.read(frames[0] + bytes(hurt) + frames[1]).damaged == 1
    assert [mpeg.header(frame(v, 3, 5, 1)[:4]).samples for v in (3, 2, 0)] == [1152, 576, 576]
    assert not mpeg.read(os.urandom(40)).headers and not mpeg.read(b"").headers
    vbri = bytearray(frames[0])
    vbri[36:62] = b"VBRI" + struct.pack(">HHHII", 1, 0, 75, 9000, 3) + bytes(8)
    s = mpeg.read(bytes(vbri) + frames[1] * 3)
    assert (s.table_bytes, s.table_frames, len(s.headers)) == (9000, 3, 3)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_mpeg_reader_takes_any_bytes(data):
    """Pieces of streams, tags and tables, cut off and overwritten anywhere."""
    vbri = frame(3, 3, 9, 0)[:36] + b"VBRI"
    kinds = [mpeg.encode(b"text" * 300), frame(3, 3, 9, 0), frame(2, 2, 5, 1, checked=True), frame(3, 1, 3, 0, checked=True), vbri, b"ID3\x03\0\0\0\0\0\x20TIT2\0\0\0\x10\0\0\x01ab", b"ID3\x04\0\0\0\0\0\x0aTIT2\0\0\0\x01\0\0", b"TAG", b"\xff"]
    parts = data.draw(st.lists(st.one_of(st.sampled_from(kinds), st.binary(max_size=20)), max_size=5))
    stream = bytearray(b"".join(p[: data.draw(st.integers(0, len(p)))] for p in parts))
    for at, value in data.draw(st.lists(st.tuples(st.integers(0, max(len(stream) - 1, 0)), st.integers(0, 255)), max_size=6)):
        if stream:
            stream[at] = value
    s = mpeg.read(bytes(stream))
    assert len(s.offsets) == len(s.headers) and s.duration >= 0 and s.damaged <= s.checked
    assert all(a + h.size <= len(stream) for a, h in zip(s.offsets, s.headers, strict=True))
    mpeg.payload(bytes(stream), s), mpeg.feature(s)


def test_mpeg_query_matches_brute_force(spark, odd, none, texts):
    media = mpeg.described(mpeg.stored(odd))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.payload), r.media_bytes, r.media_sha256) for r in media.collect())
    want = Counter()
    for i, t in texts:
        data = (t or "").encode()
        stored = mpeg.encode(data)
        want[i, len(data), data + b"\xff" * (-len(data) % 576 if data else 576), len(stored), sha256(stored).hexdigest()] += 1
    assert got == want and not mpeg.described(mpeg.stored(none)).count()


def test_mpeg_digest_columns(spark, tmp_path, odd, texts):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_mpeg_audio(spark, str(tmp_path)).collect()
    payloads = {(i, mpeg.padded((t or "").encode())) for i, t in texts}
    assert {(r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == {(i, len(p), sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, p in payloads}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>"</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve what you see on this site, and more.</p></div>
<article><h1>The  title &amp; more</h1><p><b>First paragraph with some words in it, and a line<br>break.<p>Second paragraph&nbsp;of the story; it goes on for a while &lt;here&gt;.</p>
<div class="ad">Buy now!</div><p>Short.</p></article>
<aside><p>Read this other story that has many words as well, all of them elsewhere.</p></aside>
<div id="comments"><p>A reader's comment, which is rather long and has sentences. It goes on.</p></div>
<form><p>Sign up for our newsletter here, it is free of charge and comes each week.</p><input name=q></form><footer>&copy; site</footer>"""


def test_html_page():
    assert html.main_text(PAGE) == "The title & more\n\nFirst paragraph with some words in it, and a line break.\n\nSecond paragraph of the story; it goes on for a while <here>.\n\nShort."


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>x", "&am", "<p>&am", "</p></div>", "<a><b></a>", '<p title="open>x', "<>", "text only", "<p>" * 3000, "<div>" * 2000 + "x", "<div>" * 20_000 + "x" + "</div>" * 20_000])
def test_html_broken_markup(page):
    assert isinstance(html.main_text(page), str)


def test_html_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        terminals = [rng.randint(-9, 9) for _ in range(n)]
        edges: dict = {}
        for a in range(n):
            for b in range(a):
                if rng.random() < 0.5:
                    cap = rng.randint(0, 6)
                    edges.setdefault(a, {})[b] = cap
                    edges.setdefault(b, {})[a] = cap

        def cost(side):
            cut = sum(c for a in edges for b, c in edges[a].items() if a < b and side[a] != side[b])  # noqa: B023
            return cut + sum(max(-t, 0) if s else max(t, 0) for s, t in zip(side, terminals, strict=True))  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.minimum_cut(terminals, edges)) == best


def labelled(page, odds=html.FIXED):
    """Text of each block, whether the cut keeps it, and whether its own costs alone would."""
    found, terminals, edges = html.network(page, odds)
    return [(b.text, kept, own > 0) for b, kept, own in zip(found, html.minimum_cut(terminals, edges), terminals, strict=False)]


LONG = "A paragraph of the story that goes on for some time and says what happened, to whom and why."


def test_html_cut_decides_unmarked_blocks():
    """A short line among paragraphs, and a sentence among links, go with those around them."""
    story = labelled(f"<div>{LONG}</div><div>Later that day</div><div>{LONG}</div><div>{LONG}</div>")
    assert [kept for _, kept, _ in story] == [True] * 4 and not story[1][2]
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Money"))
    menu = labelled(f"<ul>{links}<li>More of today's news.</li>{links}</ul><div>{LONG}</div><div>{LONG}</div>")
    assert [(t, own) for t, kept, own in menu if kept] == [(LONG, True)] * 2 and ("More of today's news.", False, True) in menu
    # what is marked clearly doesn't go with the others
    assert [kept for _, kept, _ in labelled(f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><p>{LONG}</p></article>")] == [True, False, True]


def test_html_pages_by_brute_force():
    """Of all labellings of a page's blocks and elements none is cheaper than the one that the text comes from."""
    rng, differ = random.Random(5), 0
    for _ in range(120):
        def part(depth=0):
            text = rng.choice([LONG, "Later that day", "Ok.", "x", '<a href="/">Home</a>', '<a href="/">A link of some length</a> and more', ""])
            tag = rng.choice(["div", "p", "li", "section", "aside", "article", 'div class="post"'])
            inner = text + (part(depth + 1) + rng.choice(["", "tail"]) if depth < 1 and rng.random() < 0.5 else "")
            return f"<{tag}>{inner}</{tag.split()[0]}>"

        page = "".join(part() for _ in range(rng.randint(1, 4)))
        found, terminals, edges = html.network(page)
        n = len(terminals)
        if n > 13:
            continue
        pairs = [(a, b, c) for a in edges for b, c in edges[a].items() if a < b]
        cost = lambda side: sum(c for a, b, c in pairs if side[a] != side[b]) + sum(max(-t, 0) if s else max(t, 0) for s, t in zip(side, terminals, strict=True))  # noqa: B023, E731
        sides = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
        best = min(sides, key=lambda side: (cost(side), sum(side)))  # of equal ones the least content
        text = "\n\n".join(b.text for b, kept in zip(found, best, strict=False) if kept)
        assert cost(html.minimum_cut(terminals, edges)) == cost(best)
        if sum(cost(s) == cost(best) for s in sides) == 1:
            assert html.main_text(page) == text
            differ += any(kept != (own > 0) for kept, own in zip(best, terminals[: len(found)], strict=False))
    assert differ >= 10


def test_html_look_is_learned(spark):
    def page(i):
        nav = "".join(f"<li><a href='/'>{w}</a></li>" for w in ("Home", "World", "Sport"))
        return f"<nav><ul>{nav}</ul></nav><article><p>{LONG} {i}.</p><p>{LONG} {i}.</p></article><footer>short {i}</footer>"

    pages = spark.createDataFrame([(i, page(i % 90)) for i in range(400)], "page_id long, html string")
    odds = html.learn(pages)
    assert odds["links3"] < -2 < 0 < odds["sentence1"] and odds["length7"] > 1 > odds["length4"] and odds == html.learn(pages.repartition(7))
    assert html.learn(pages, sample_pages=3) == html.learn(pages.limit(0)) == html.FIXED
    none = spark.createDataFrame([(1, None)], "page_id long, html string")
    assert html.learn(none) == html.FIXED


def test_html_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, None), (4, "u", "<article><p>" + "word " * 40_000, "x"), (4, "u", "<p>a</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extracted(pages).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id == 1 or r.page_id == 2} == {0} and all(len(r.text) == r.n_chars for r in got)
    assert max(r.n_chars for r in got) == 40_000 * 5 - 1
    assert not html.extracted(pages.limit(0)).count()


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_transducer_counts_like_the_library(sp):
    rng, own = random.Random(5), transducer.transducer(PIECES)
    some = [sp.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(3000)]
    odd_ones = ["a", "▁", " ", "  ", "\n", "\t", "é", "中", "😀", "\x00", "<s>", "</s>", "<0x0A>", "<unk>", "...", "🏳️‍🌈", "ß", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(odd_ones) if rng.random() < 0.4 else rng.choice(some) for _ in range(rng.randint(0, 15)))
        assert own.count(text) == len(sp.encode(text)), repr(text)


def test_transducer_chunk_maps_compose(sp, monkeypatch):
    monkeypatch.setattr(transducer, "REMEMBERED_PAIRS", 50)
    own = transducer.Transducer(transducer.transducer(PIECES).pieces.scores)
    texts = ["the end of many words " * 50, "", "one", "  two  blanks", "x" * 30]
    before, starts = own.scanned(texts)
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        chunks = own.chunks(text)
        assert len(chunks) == b - a and before[b] - before[a] == len(sp.encode(text))
        for k in range(len(chunks) + 1):
            assert before[a + k] - before[a] == sum(own.run(c)[1] for c in chunks[:k])
        assert all(own.run(c)[1] == own.run(c, own.start)[1] for c in chunks)
    assert len(own.pieces._lawful) <= 50


def test_transducer_refuses_pieces_over_blanks():
    with pytest.raises(ValueError):
        transducer.Pieces({"a▁b": 0.0})


def test_token_counts_query(spark, odd, none, texts, sp):
    rows = transducer.token_counts(odd, PIECES).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in texts)
    text = dict(texts)[8]
    fitting = next(r.n_fitting for r in rows if r.doc_id == 8)
    tokens = [len(sp.encode(" ".join(text.split(" ")[:k]))) for k in (fitting, fitting + 1)]
    assert tokens[0] <= 4096 < tokens[1] and all(r.n_fitting == 1 for r in rows if r.doc_id == 5)
    assert got == want and not transducer.token_counts(none, PIECES).count()


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_pieces_like_the_library(encoding):
    rng, own, cut = random.Random(7), bpe.vocabulary(RANKS), regex.compile(public_tokenizers.PATTERN)
    texts = ["".join(rng.choice("abcdeéü 中1'.\n<|endoftext|>😀\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 900, "aab" * 400, " " * 900, "=" * 700, "".join(rng.choice("etaoin") for _ in range(900)), "don't we'll <|endoftext|>"]
    pieces = [cut.findall(t) for t in texts]
    for text, n, ids, decoded in zip(texts, *own.of_texts(pieces), strict=True):
        assert ids.decode() == " ".join(map(str, encoding.encode_ordinary(text))) and n == len(ids.split())
        assert decoded == text.encode()


@pytest.mark.parametrize(
    "make",
    [
        lambda rng: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)),
        lambda rng: "".join(rng.choice("ACGT") for _ in range(40_000)),
        lambda rng: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(20_000)),
        lambda rng: "".join(rng.choice(["the", "in", "tion", "er", "a", "qu", "é", "中"]) for _ in range(6_000)),
        lambda rng: "".join(rng.choice("ab") for _ in range(90)) * 200,
        lambda rng: "a" * 100_001,
    ],
)
def test_bpe_long_pieces(encoding, make):
    text = make(random.Random(12))
    ((n,), (ids,), (decoded,)) = bpe.vocabulary(RANKS).of_texts([[text]])
    assert ids.decode() == " ".join(map(str, encoding.encode_ordinary(text))) and n == len(ids.split()) and decoded == text.encode()


def test_bpe_seams_of_small_blocks(monkeypatch, encoding):
    """Blocks of a few bytes, so that most seams fail and many windows grow over whole pieces."""
    monkeypatch.setattr(bpe, "LONG", 6)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    monkeypatch.setattr(bpe, "QUERY_SQUARES", 60)
    rng, own = random.Random(13), bpe.Vocabulary(bpe.read_ranks(RANKS))
    texts = ["".join(rng.choice(["the", "tion", "ing", "x", "ab", "é", "nation", "under"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    for text, ids in zip(texts, own.of_texts([[t] for t in texts])[1], strict=True):
        assert ids.decode() == " ".join(map(str, encoding.encode_ordinary(text))), text


def test_bpe_forgets_and_goes_on(monkeypatch):
    own = bpe.Vocabulary(bpe.read_ranks(RANKS))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    first = own.of_texts([["one", "two", "three", "four", "five"], ["five"]])
    again = own.of_texts([["five", "six"], []])
    assert again[1][0].startswith(first[1][1] + b" ") and again[2] == [b"fivesix", b""] and again[0][1] == 0
    assert "six" in own.places and "one" not in own.places and len(own.known) == len(own.places)


def test_bpe_query(spark, odd, none, texts, encoding):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += 1
    assert got == want and not bpe.digests(none, RANKS, public_tokenizers.PATTERN).count()
    full = {r.doc_id: r for r in bpe.encoded(odd.where("doc_id = 7"), RANKS, public_tokenizers.PATTERN).collect()}
    text = dict(texts)[7]
    assert full[7].ids == encoding.encode_ordinary(text) and bytes(full[7].decoded).decode() == text


def test_html_marks_need_evidence():
    """One doubtful word doesn't outdo an article's marks; an article's own header stays, a page's goes; notes of rights go unless an article holds them."""
    kept = lambda page: html.main_text(page).split("\n\n")
    assert kept(f"<article><p>{LONG}</p><section class='post-text related-work'><p>{LONG} Related.</p></section></article>") == [LONG, f"{LONG} Related."]
    assert kept(f"<main><p>{LONG}</p><div class='share search social'><p>Tell others.</p></div></main>") == [LONG]
    title = "<header><h1>The title of it all</h1></header>"
    assert kept(f"<header><h1>The daily page</h1></header><article>{title}<p>{LONG}</p></article>") == ["The title of it all", LONG]
    note = "Copyright 2020 The Daily Page. All rights reserved."
    assert kept(f"<div>{LONG}</div><div>{LONG}</div><div>{note}</div>") == [LONG, LONG]
    assert kept(f"<article><p>{LONG}</p><p>All rights reserved.</p></article>") == [LONG, "All rights reserved."]
