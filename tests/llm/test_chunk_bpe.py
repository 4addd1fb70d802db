"""Encoding by shared chunks against the library, cuts that follow content, and joins through words."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from doclens.llm import chunk_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "a", "The", "tion", "1", "23", "é", "é", "̣", "!!", "<|endoftext|>", "<|start", "oftext|>", "日本", "ΑΣ", "İ", "_", "\r\n", "don't", "x" * 50, " ", "\u0085", "\x1c", " ", "😀"]


def drawn(rng, n):
    return "".join(rng.choice(ALPHABET) + (" " if rng.random() < 0.5 else "") for _ in range(n))


LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return LIBRARY.encode_batch(texts, add_special_tokens=False)


def want(text):
    t = LIBRARY
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_joins_anywhere_give_the_ids_of_the_whole_text():
    rng, own = random.Random(5), chunk_bpe.codec(PATH)
    for n in (0, 1, 3, 20, 60, 200):
        for _ in range(40):
            text = drawn(rng, n)
            at = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
            parts = []
            for a, b in zip([0, *at], [*at, len(text)]):
                ends = chunk_bpe.edges(text[a:b])
                parts.append((None, own.encode([text[a:b]])[0], *ends) if ends and rng.random() < 0.6 else (text[a:b], None, None, None))
            assert chunk_bpe.stitched(parts, own) == own.encode([text])[0]
            assert own.digests(own.encode([text])[0]) == want(text)


def test_cuts_follow_content():
    rng = random.Random(6)
    passage = drawn(rng, 2000)
    a, b = chunk_bpe.chunks(drawn(rng, 150) + passage), chunk_bpe.chunks(drawn(rng, 333) + passage)
    assert "".join(a).endswith(passage) and len(set(a) & set(b)) > 5
    assert all(len(c) <= chunk_bpe.GREATEST for c in chunk_bpe.chunks("a" * 20_000)) and "".join(chunk_bpe.chunks("ab" * 9000)) == "ab" * 9000
    assert chunk_bpe.chunks("") == [""]


def test_every_text_as_the_library_has_it(spark):
    rng = random.Random(7)
    passages = [drawn(rng, 600) for _ in range(3)] + ["z" * 9000]
    texts = [drawn(rng, rng.randint(0, 300)) + rng.choice(passages) + drawn(rng, rng.randint(0, 300)) for _ in range(40)]
    texts += [None, "", " ", passages[0], passages[0], passages[3], texts[0], texts[0], "'" * 700]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").repartition(3)
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in chunk_bpe.encoded(df, PATH).collect()))
    assert got == sorted((i or -1, *want(t)) for i, t, _ in rows)
    assert chunk_bpe.encoded(df.limit(0), PATH).count() == 0


def test_a_full_store_of_fields_changes_nothing(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "KEPT_FIELDS", 3)
    rng, own = random.Random(8), chunk_bpe.Codec(PATH)
    texts = [drawn(rng, 30) for _ in range(50)]
    for begin in (0, 10, 5, 0):
        some = texts[begin : begin + 20]
        assert [len(i) // own.width.itemsize for i in own.encode(some)] == [len(e.ids) for e in library(some)]


def test_plain_fields_have_the_ids_of_the_library_without_a_call_of_it(monkeypatch):
    rng, own = random.Random(9), chunk_bpe.Codec(PATH)
    signs = [chr(i) for i in range(0x21, 0x7F)] + list("ÀÉÖØÞßàéöøÿ")
    parts = ["'s", "'RE", "'ll", "''", "tion", "The", "zu", "1", ".", ","]
    fields = ["".join(rng.choice(signs if rng.random() < 0.3 else parts) for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    fields += [t.removesuffix("</w>") for t in own.tokens] + ["a" * 64, "é" * 64, "z" * 63 + "."]
    plain = sorted({f for f in fields if chunk_bpe.PLAIN.fullmatch(f) and "<|" not in f})
    expected = {f: np.array(e.ids, own.width).tobytes() for f, e in zip(plain, library(plain))}
    asked = []
    by_library = own._by_library
    monkeypatch.setattr(own, "_by_library", lambda fields: asked.extend(fields) or by_library(fields))
    assert len(plain) > 40_000 and own.encode([" ".join(plain)]) == [b"".join(expected[f] for f in plain)] and asked == []
    assert {f: own.field(f) for f in plain} == expected and asked == []
    others = ["a\u0301", "\u65e5\u672c", "<|endoftext|>", "x\u00b2", "a\u00a0b", "a\x0bb", "b" * 65]
    assert own.encode([" ".join(others)])[0] == b"".join(np.array(e.ids, own.width).tobytes() for e in library(others)) and sorted(asked) == sorted(others)


def test_a_vocabulary_that_tiktoken_reads_otherwise_stays_with_the_library(tmp_path):
    spec = json.loads(LIBRARY.to_str())
    base = [t for t, i in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1]) if i < 512]
    texts = ["abc", "abcd Abcd, dabc", "ab bc", "it's"]

    def made(name, merges, **changed):
        """A file with these merges, their tokens in this order unless `vocab` says otherwise."""
        words = changed.pop("vocab", None) or [a + b for a, b in merges]
        held = {t: i for i, t in enumerate([*base, *words])}
        added = [t | {"id": len(held) + i} for i, t in enumerate(spec["added_tokens"])]
        path = str(tmp_path / name)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | {"added_tokens": added, "model": spec["model"] | {"vocab": held, "merges": merges}} | changed, f)
        return path

    rising = made("rising", [("a", "b"), ("ab", "c")])
    cases = {
        rising: True,
        made("falling", [("a", "b"), ("b", "c")], vocab=["bc", "ab"]): False,
        made("unreached", [("a", "b"), ("b", "c"), ("a", "bc")]): False,  # abc is ab and c, never a and bc
        made("case", [("a", "b"), ("ab", "c")], normalizer={"type": "NFC"}): False,
    }
    for path, plain in cases.items():
        own, own_library = chunk_bpe.Codec(path), Tokenizer.from_file(path)
        assert (own.merger is not None) == plain
        assert own.encode(texts) == [np.array(e.ids, own.width).tobytes() for e in own_library.encode_batch(texts, add_special_tokens=False)]


def test_a_sent_chunk_with_its_ids_is_not_encoded_again(monkeypatch):
    rng, own = random.Random(10), chunk_bpe.codec(PATH)
    for n in (1, 20, 200):
        text = drawn(rng, n)
        at = sorted(rng.randint(0, len(text)) for _ in range(4))
        parts = [(t, own.encode([t])[0], None, None) for t in (text[a:b] for a, b in zip([0, *at], [*at, len(text)]))]
        whole = own.encode([text])[0]
        assert chunk_bpe.stitched(parts, own) == whole
        with monkeypatch.context() as m:
            m.setattr(own, "encode", lambda texts: [own._fresh([t])[t] for t in texts if len(chunk_bpe.split(t)) == 1])  # single fields of joins alone
            assert chunk_bpe.stitched(parts, own) == whole
