"""Token files, packing, BPE and chat: exact round trips and the tokenizers themselves."""

import hashlib
import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from tablewarden.llm import bpe, chat, encode, packing, token_file

ODD = ["it's  a\tb\n\n x   y <|endoftext|> İΣ ﬁ ²", None, "", "  ", "\n\n\na", "don't 'S It'S 12a ÷×ª €", "a \n", "a\n b  c",
       "  x y", "word " * 3000, "x" * 900, " \n" * 300 + "a", "ab  \n cd " * 60, "été à la Straße, ÉTÉ."]
SCHEMA = "doc_id long, text string, row string, ids string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_words_give_the_tokenizers_ids(name):
    path = public_tokenizers.path(name)
    coder, plain = encode.TextEncoder(path), Tokenizer.from_file(path)
    marks = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y <| z |>", "a<|endoftext|>"]
    for text in ODD[:1] + ODD[2:] + marks:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == ids
    spelled = encode.TextEncoder(path, spell_special=True)
    assert all(spelled.encode(t) == (spelled.whole(t) if t else b"") for t in ODD[:1] + ODD[2:] + marks)
    assert spelled.encode(marks[0]) != coder.encode(marks[0])
    coder.forget()
    assert coder.encode("word word") == coder.whole("word word")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=900))
def test_blocks_give_back_their_ids(ids):
    ids = np.array(ids, np.uint32)
    payload = token_file.pack(ids)
    assert (token_file.unpack(payload) == ids).all()
    if len(ids) > 512:
        assert (token_file.unpack(payload, 1, 2) == ids[256:512]).all()


def frame(spark):
    rows = [(i, t, "r", "i") for i, t in enumerate(ODD)] + [(None, "a b", "r", "i"), (3, "again", "r", "i")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [r[:2] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs, rows = frame(spark)
    tokenizer = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = token_file.token_digests(docs, path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_file.token_digests(docs.limit(0), path).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs, rows = frame(spark)
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack_documents(docs, path, end_id=0, window=64)
    got = packing.piece_digests(pieces).collect()
    streams = {}
    for r in got:
        streams.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(streams) == list(range(len(streams)))
    for s, parts in streams.items():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        assert s == len(streams) - 1 or sum(n for _, n in parts) == 64
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i and r.doc_tokens == len(ids))
        want.append(len(ids))
        cut = [(s, n, crc(ids[s : s + n])) for s, n, _ in mine]
        assert i == 3 or mine == cut and sum(n for _, n, _ in mine) == len(ids)
    assert sum(r.length for r in got) == sum(want)
    padded = packing.sequences(pieces, pad_id=9, window=64).collect()
    assert all(len(r.ids) == 64 or len(r.ids) == r.tokens for r in padded)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 10), (100, 20)])
def test_byte_bpe_is_that_of_the_library(spark, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.coder(path, public_tokenizers.PATTERN)
    docs, rows = frame(spark)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.round_trips(docs, path, public_tokenizers.PATTERN, chunk, overlap)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@given(st.text() | st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "␛", "1", "[", "/"])).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok ␛1[/INST]"), (2, 0, None, None),
             (2, 1, "assistant", ""), (2, 2, "assistant", "é ü"), (3, None, "a", "first"), (3, 1, "assistant", "x"),
             (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, start long, ids string")
    want = []
    for conv in (1, 2, 3, None):
        own = [t for t in turns if t[0] == conv]
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        want.append((conv, len(own), sha[0], len(loss), sha[1]))
    got = chat.read_back(chat.format_conversations(df, path), path).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert chat.read_back(chat.format_conversations(df.limit(0), path), path).count() == 0


def test_modules_import_the_arrow_functions_they_use():
    # A Python worker of a cluster starts with one module; nothing else has imported pyarrow.compute there.
    folder = pathlib.Path(encode.__file__).parent
    users = [p.stem for p in sorted(folder.glob("*.py")) if "pa.compute" in p.read_text()]
    assert "chat" in users
    for name in users:
        code = f"import pyarrow as pa, tablewarden.llm.{name}; pa.compute"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=folder.parents[1])


def test_many_texts_at_once_equal_the_library_and_look_each_token_up_once():
    coder = encode.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pick = random.Random(8)
    signs = ["a", "B", "é", "É", " ", "  ", "\n", "'s", "'S", "don't", "''s", "'ll", "12", "_", "%", "<", "ß", "İ", "\t",
             "\x1c", "<|endoftext|>", "中", "\r\n"]
    texts = ["".join(pick.choices(signs[: 17 if i % 3 else None], k=pick.randrange(25))) for i in range(3000)]
    texts += [None, "", " ", "\n \n", "word " * 50]
    assert coder.encode_many(texts) == [coder.whole(t or "") for t in texts] and coder.encode_many([]) == []
    coder.forget()
    asked = []
    memory = coder.ids_of_token.__self__
    memory.encode = lambda token, plain=memory.encode: asked.append(token) or plain(token)
    encode_, encode.CACHED_WORDS = encode.CACHED_WORDS, 0  # nothing is remembered
    try:
        coder.encode_many(["Two words, two words. TWO 22"] * 40)
    finally:
        encode.CACHED_WORDS = encode_
    assert sorted(asked) == sorted(["two", "words", ",", ".", "2"])
