import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import encode
from brindle.llm.bpe import SPLIT, Encoder, Merges, StreamDecoder, Utf8Machine, encoder, tokenizer_dir
from brindle.llm.encode import decode_ids, encode_texts, vocabulary

FOLDER = tokenizer_dir()


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=400)
@given(st.text(st.sampled_from("ab aAzZ09 '\n\tst.,=-€ß日語😀ру\x00"), max_size=80))
def test_equals_the_public_library(public, text):
    assert encoder(vocabulary()).encode(text) == public.encode_ordinary(text)


def test_unusual_texts(public):
    e = encoder(vocabulary())
    for t in ("<|endoftext|>", " <|endoftext|>x", "=" * 3000, "a" * 5000, "ab" * 2000, "é" * 999, "​﻿\r\n", " " * 4000 + "x", "don't've", "𝔘𝔫𝔦" * 50):
        assert e.encode(t) == public.encode_ordinary(t), t[:20]
    assert e.encode("") == [] and e.encode(None) == []


def naive(pieces, rank):
    """Merges the best neighbours, again and again."""
    while True:
        best = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(pieces, pieces[1:], strict=False))) if len(pieces) > 1 else (1 << 60, 0)
        if best[0] == 1 << 60:
            return pieces
        i = best[1]
        pieces = [*pieces[:i], pieces[i] + pieces[i + 1], *pieces[i + 2 :]]


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10**9))
def test_random_merges(seed):
    """Any merge list, with tokens that don't encode themselves, against merging step by step."""
    pick = random.Random(seed)
    known, merges, ids = ["a", "b", "c"], [], {"a": 0, "b": 1, "c": 2}
    for _ in range(pick.randint(0, 14)):
        x, y = pick.choice(known), pick.choice(known)
        if x + y not in ids and len(x + y) < 9:
            ids[x + y] = len(ids)
            merges.append((x, y))
            known.append(x + y)
    e = Encoder(Merges({i: s.encode() for s, i in ids.items()}, [(ids[x], ids[y], ids[x + y]) for x, y in merges]), r"[abc]+")
    rank = {m: r for r, m in enumerate(merges)}
    for _ in range(30):
        text = "".join(pick.choice("abc") for _ in range(pick.randint(0, 24)))
        assert [e.merges.tokens[i].decode() for i in e.encode(text)] == naive(list(text), rank)


def test_tokens_come_out_early():
    """The transducer holds back less than the longest token's bytes."""
    e = encoder(vocabulary())
    longest = max(map(len, e.merges.tokens.values()))
    data, fed, out = b"antidisestablishmentarianism" * 20, 0, 0

    def feed():
        nonlocal fed
        for b in data:
            fed += 1
            yield b

    for t in e.stream(feed()):
        out += len(e.merges.tokens[t])
        assert fed - out < 2 * longest


def test_memory_stays_bounded(monkeypatch):
    from brindle.llm import bpe

    monkeypatch.setattr(bpe, "STATES", 40)
    monkeypatch.setattr(bpe, "PIECES", 5)
    e = Encoder(encoder(vocabulary()).merges)
    pick = random.Random(2)
    for _ in range(200):
        text = "".join(pick.choice("abcdefgh ") for _ in range(60))
        assert e.encode(text) == encoder(vocabulary()).encode(text)
        assert len(e._known) <= 5 and len(e._states) <= 40 + 70


@settings(deadline=None, max_examples=300)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_decoding_any_bytes_in_parts(data, step):
    d = StreamDecoder({i: bytes([i]) for i in range(256)})
    out = "".join(d.feed(data[i : i + step]) for i in range(0, len(data), step)) + d.close()
    assert out == data.decode("utf-8", "replace")


def test_utf8_machine():
    for c in ("a", "é", "日", "😀", "￿", "\U0010ffff"):
        m = Utf8Machine()
        assert [m.step(b) for b in c.encode()] == [None] * (len(c.encode()) - 1) + [True]
    for bad in (b"\xc0", b"\xff", b"\xe0\x80", b"\xed\xa0", b"\xf4\x90", b"\x80"):
        m = Utf8Machine()
        assert [m.step(b) for b in bad][-1] is False


ROWS = [(1, "Hello world"), (2, ""), (3, None), (4, "ñandú 😀" * 3), (4, "ñandú 😀" * 3), (None, "x"), (5, "long text, " * 30_000)]


def test_operator(spark, public, monkeypatch):
    monkeypatch.setattr(encode, "PART", 50)
    df = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, ids string")
    got = encode_texts(df, "text", ["doc_id"]).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(i, public.encode_ordinary(t or "")) for i, t in ROWS]
    back = decode_ids(encode_texts(df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()
    assert [(r.doc_id, r.text) for r in back] == [(i, t or "") for i, t in ROWS]
    assert encode_texts(df.limit(0), "text", ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        encode_texts(df, "text", ["ids"])


def test_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = encoder(vocabulary())
    for text in ("It's 3 o'clock.", "  two  blanks ", "<|endoftext|>"):
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_unknown_ids_and_bounded_states(spark, monkeypatch):
    from brindle.llm import bpe
    from brindle.llm.encode import decode_ids, vocabulary

    known = bpe.encoder(vocabulary())
    hello = known.encode("héllo")
    df = spark.createDataFrame([(1, hello), (2, [hello[0], 10**8, -1]), (3, None), (4, [])], "i int, ids array<int>")
    got = {r.i: r.text for r in decode_ids(df, "ids", ["i"]).collect()}
    first = known.merges.tokens[hello[0]].decode()
    assert got == {1: "héllo", 2: first + "��", 3: "", 4: ""}
    # one piece that needs more states than are kept
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(6000))
    want = known.encode(long)
    monkeypatch.setattr(bpe, "STATES", 50)
    few = bpe.Encoder(known.merges)
    assert few.encode(long) == want and len(few._states) <= 60


def test_vocabulary_is_sent_along(spark):
    """Executors find the file by its name among those sent with the job."""
    from pyspark import SparkFiles

    from brindle.llm.encode import ship, vocabulary

    assert ship(spark, vocabulary()) == "byte_bpe_50k.json"
    assert open(SparkFiles.get("byte_bpe_50k.json")).read(1) == open(vocabulary()).read(1)
