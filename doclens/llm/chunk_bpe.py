"""BPE ids of whole texts, with chunks that several texts share encoded once, and back.

Texts are cut where a rolling hash of the last characters says so: the places
depend on what stands there alone, so a passage is cut alike wherever it occurs.

1. Chunks are counted by their digest.  Those that occur at least twice are
   marked in a bitmap of bounded size; a chunk that is marked by mistake only takes
   the same way as a shared one.
2. Marked chunks are stored once and encoded once, each on its own.
3. A text without a marked chunk is encoded where it stands.  The others send
   their unmarked chunks as text and the marked ones as digests, which are joined
   with the ids of 2.
4. A cut may go through a word, so the ids on both sides of it aren't those of
   the text.  Each join is repaired: the fields (runs between white space)
   that the cut touches are encoded again together with a whole field on both sides.
   While one side has no such field the window takes in the next chunk.  The repair
   is done when the outer fields' new ids are exactly those of the chunks; this must
   happen, since no token reaches over white space, and is checked at each join.

Ids of one field are kept in a store of bounded size.  They come from the library, but
for plain fields (short, of Latin letters, digits and ASCII signs) of a vocabulary for which
tiktoken is shown to give the same ids; it takes a quarter of the time for a new field.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, whole_text
from .shingles import mix
from .suffix_dedup import _bitmap, _in_bitmap
from .token_counts import _byte_letters

#: Mean, least and greatest length of a chunk in characters, and the characters that a cut depends on.
MEAN, LEAST, GREATEST, WINDOW = 512, 128, 4096, 32
#: Fields whose ids a worker keeps; beyond it the store is emptied and fills again.
KEPT_FIELDS, FIELD_CHARS = 400_000, 64
#: What stands between fields that go to the library together, and how many do.
MARK, JOINED = "\x00", 1000
#: How a vocabulary file whose plain fields tiktoken may take changes and splits texts, and marks the end of a word.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITS = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
SUFFIX, END = "</w>", "\x00"
#: Plain fields, and PATTERN for them in lower case: characters that compose with none of the others, and are letters, digits or signs in all versions of Unicode.
PLAIN = re.compile(f"[!-~À-ÖØ-öø-ÿ]{{1,{FIELD_CHARS}}}")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")
#: Rows, and characters, that a task works on at a time.
ROWS, BATCH_CHARS = 500, 1 << 21

PIECES = "kind byte, doc_id long, key binary, seq int, digest binary, text string, n_tokens long, ids_sha256 string, decoded_sha256 string"
DONE, LINK, PIECE = 0, 1, 2


class Codec:
    """Encoding and decoding with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        n = self.library.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.tokens = [self.library.id_to_token(i) or "" for i in range(n)]
        self.numbers = [str(i) for i in range(n)]
        self.known: dict[str, bytes] = {}
        self.merger, self.blank = self._merger()

    def _merger(self):
        """tiktoken's encoder of this vocabulary for words that end in END, and the id it has for a blank; None where its ids could be others.

        It joins any two neighbours that make up a token, the least id first; the library joins those that
        a merge names.  That is the same where ids rise with the merges and each token, encoded, is itself: what a
        token is made of is then joined by its own merge alone.
        """
        import tiktoken
        from tokenizers import models

        spec = json.loads(self.library.to_str())
        vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges")
        options = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges", "ignore_merges")}
        expected = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": SUFFIX, "fuse_unk": False, "byte_fallback": False}
        same = options == expected and spec["normalizer"] == {"type": "Sequence", "normalizers": NORMAL} and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": SPLITS}
        if not same or any("<|" not in t["content"] for t in spec["added_tokens"]):
            return None, None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        letters = _byte_letters()
        made = [vocab[a + b] for a, b in pairs]
        single = [vocab.get(c + e, len(vocab)) for c in letters for e in ("", SUFFIX)]
        rising = made == sorted(made) and max(single) < min(made, default=len(vocab)) and all(max(vocab[a], vocab[b]) < i for (a, b), i in zip(pairs, made))
        if not rising or len(set(single) | set(made)) != len(vocab):
            return None, None
        inner = models.BPE(vocab, pairs)
        ranks = {END.encode(): len(self.tokens)}
        for t, i in vocab.items():
            word = t.removesuffix(SUFFIX)
            if [x.id for x in (inner.tokenize(t) if word == t else self.library.model.tokenize(word))] != [i]:
                return None, None
            raw = bytes([letters[c] for c in word])
            if 0 not in raw:  # plain fields hold no such byte
                ranks[raw if word == t else raw + END.encode()] = i
        return tiktoken.Encoding("words", pat_str=f"[^{END} ]+{END}| ", mergeable_ranks=ranks, special_tokens={}), ranks[b" "]

    def _by_words(self, fields: list[str]) -> dict[str, bytes]:
        """The ids of plain fields, in one call with a blank between them."""
        ids = self.merger.encode_to_numpy(WORDS.sub(rf"\g<0>{END}", " ".join(fields).lower()))
        ends = np.append(np.flatnonzero(ids == self.blank), len(ids)).tolist()
        if len(ends) != len(fields):
            raise ValueError("a blank between fields was not kept")
        held, size = ids.astype(self.width).tobytes(), self.width.itemsize
        return {f: held[size * a : size * b] for f, a, b in zip(fields, [0, *[x + 1 for x in ends]], ends)}

    def _fresh(self, fields: list[str]) -> dict[str, bytes]:
        """The ids of fields that aren't kept."""
        plain = [f for f in fields if PLAIN.fullmatch(f) and "<|" not in f] if self.merger else []
        found = self._by_words(plain) if plain else {}
        rest = [f for f in fields if f not in found]
        return found | self._by_library(rest) if rest else found

    def _by_library(self, fields: list[str]) -> dict[str, bytes]:
        """The ids of fields: many in one call, with a mark of a known id between them; those that hold a mark or a special string one by one."""
        apart = [f for f in fields if self.mark is None or MARK in f or "<|" in f]
        found = {f: np.array(e.ids, self.width).tobytes() for f, e in zip(apart, self.library.encode_batch_fast(apart, add_special_tokens=False))}
        rest = fields if not apart else [f for f in fields if f not in found]
        runs = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        for run, e in zip(runs, self.library.encode_batch_fast([f" {MARK} ".join(run) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.width)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            if len(ends) != len(run):
                raise ValueError("a mark between fields was not kept")
            found.update((f, ids[a:b].tobytes()) for f, a, b in zip(run, [0, *[x + 1 for x in ends]], ends))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as numbers of `width`; fields are encoded one by one, those met before are looked up."""
        fields = [split(t) for t in texts]
        new = self._fresh(list({f for run in fields for f in run if f not in self.known}))
        if len(self.known) + len(new) > KEPT_FIELDS:
            new |= {f: self.known[f] for run in fields for f in run if f in self.known}
            self.known.clear()
        known, look = self.known, (new or self.known).get
        out = [b"".join([known.get(f) or look(f) or b"" for f in run]) for run in fields]
        self.known.update((f, i) for f, i in new.items() if len(f) <= FIELD_CHARS)
        return out

    def field(self, field: str) -> bytes:
        """The ids of one field."""
        return self.known.get(field) or self.encode([field])[0]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens for a file without a decoder: tokens joined by one space."""
        return " ".join([self.tokens[i] for i in ids])

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text."""
        held = np.frombuffer(ids, self.width).tolist()
        written = " ".join([self.numbers[i] for i in held])
        return len(held), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(held).encode()).hexdigest()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def split(text: str) -> list[str]:
    """Fields of a text: no token reaches over these four characters, and none holds one."""
    return [f for f in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if f]


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text: where the rolling hash of the WINDOW characters before has its upper bits zero."""
    n = len(text)
    if n <= LEAST:
        return [n]
    h = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    places = (np.flatnonzero(h >> np.uint64(65 - MEAN.bit_length()) == 0) + 1).tolist()
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > GREATEST:
            last += GREATEST
            ends.append(last)
        if p - last >= LEAST or p == n:
            if p > last:
                ends.append(p)
            last = p
    return ends


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(data: str) -> bytes:
    return hashlib.blake2b(data.encode(), digest_size=16).digest()


def _slot(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([d[:8] for d in digests]), "<i8")


def edges(text: str) -> tuple[str, str] | None:
    """What a repair needs of a chunk: its first two and its last two fields, as they stand there; None where fewer than four fields are."""
    fields = split(text)
    if len(fields) < 4:
        return None
    at = text.index(fields[1], text.index(fields[0]) + len(fields[0])) + len(fields[1])
    back = text.rindex(fields[-2], 0, text.rindex(fields[-1]))
    return text[:at], text[back:]


def stitched(parts: list[tuple[str | None, bytes | None, str | None, str | None]], codec: Codec) -> bytes:
    """Ids of a text from its chunks in order, each as its text, with its ids if they are known, or as (None, ids, first fields, last fields)."""
    out, begun, left = [], None, None  # left: the last fields of the last whole chunk; begun: its ids
    window = ""

    def repaired(right: str) -> bytes:
        """Ids of the window, without those of the outer fields that the chunks keep."""
        whole = b"".join([codec.field(f) for f in split(window + right)])
        before = codec.field(split(left)[0]) if left else b""
        after = codec.field(split(right)[-1]) if right else b""
        if not (whole.startswith(before) and whole.endswith(after) and len(whole) >= len(before) + len(after)):
            raise ValueError("chunks can't be joined: a token reaches over white space")
        return whole[len(before) : len(whole) - len(after)]

    for text, ids, head, tail in parts:
        if text is not None:
            found = edges(text)
            if found is None:
                window += text
                continue
            ids, (head, tail) = codec.encode([text])[0] if ids is None else ids, found
        first, rest = split(head), split(tail)
        n_first = len(codec.field(first[0]))
        if begun is not None:
            out.append(begun)
        out.append(repaired(head))
        # the chunk's own ids from its second field on, up to and with its last but one
        begun = ids[n_first : len(ids) - len(codec.field(rest[1]))]
        left = window = tail
    if begun is not None:
        out.append(begun)
    out.append(repaired(""))
    return b"".join(out)


def _batches(pdf: pd.DataFrame):
    """Row numbers of runs of BATCH_CHARS characters about."""
    run, held = [], 0
    for i, t in enumerate(pdf["text"]):
        run.append(i)
        held += len(t)
        if held >= BATCH_CHARS or len(run) >= ROWS:
            yield run
            run, held = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, without special tokens added.

    A null text is an empty one, with no ids, which decodes to the empty text.
    Rows that repeat an id or a text, and rows with a null id, are rows of their
    own; columns of other names are not read.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def digests(batches):
        for pdf in batches:
            for run in _batches(pdf):
                yield pd.DataFrame({"digest": [digest(c) for i in run for c in chunks(pdf["text"].iat[i])]})

    counted = rows.select("text").mapInPandas(digests, "digest binary").groupBy("digest").count()
    shared = steps.written(counted.filter("count > 1").select("digest"))
    bits = spark.sparkContext.broadcast(_bitmap(shared, ["digest"], lambda pdf: _slot(pdf["digest"].tolist())))

    def marked(text: str) -> list[tuple[str, bytes, bool]]:
        found = chunks(text)
        names = [digest(c) for c in found]
        return list(zip(found, names, _in_bitmap(bits.value, _slot(names)).tolist()))

    def pieces(batches):
        own = codec(path)
        for pdf in batches:
            for run in _batches(pdf):
                out, alone = [], []
                for i in run:
                    doc_id, text = pdf["doc_id"].iat[i], pdf["text"].iat[i]
                    found = marked(text) if text else []
                    if not any(m for _, _, m in found):
                        alone.append((doc_id, text))
                        continue
                    key = digest(text)
                    out.append((LINK, doc_id, key, None, None, None, None, None, None))
                    out += [(PIECE, None, key, n, d, None if m else c, None, None, None) for n, (c, d, m) in enumerate(found)]
                for (doc_id, _), ids in zip(alone, own.encode([t for _, t in alone])):
                    out.append((DONE, doc_id, None, None, None, None, *own.digests(ids)))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64", "seq": "Int32", "n_tokens": "Int64"})

    def marked_chunks(batches):
        for pdf in batches:
            for run in _batches(pdf):
                found = {d: c for i in run for c, d, m in marked(pdf["text"].iat[i]) if m}
                if found:
                    yield pd.DataFrame({"digest": list(found), "text": list(found.values())})

    def encode(batches):
        own = codec(path)
        for pdf in batches:
            for run in _batches(pdf):
                part = pdf.iloc[run]
                ends = [edges(t) for t in part["text"]]
                ids = own.encode(part["text"].tolist())
                short = [None if e else t for e, t in zip(ends, part["text"])]
                yield pd.DataFrame({"digest": part["digest"].tolist(), "short": short, "ids": ids, "head": [e and e[0] for e in ends], "tail": [e and e[1] for e in ends]})

    once = rows.select("text").mapInPandas(marked_chunks, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))
    known = steps.written(once.mapInPandas(encode, "digest binary, short string, ids binary, head string, tail string"))
    held = steps.written(rows.mapInPandas(pieces, PIECES))
    steps.drop(shared)

    part = held.filter(F.col("kind") == PIECE)
    # a text that occurs again sends the same pieces again; unmarked chunks occur once, so only texts that stand alone have them
    asked = part.filter("text IS NULL").select("key", "seq", "digest").distinct()
    fetched = asked.join(known, "digest").select("key", "seq", F.col("short").alias("text"), "ids", "head", "tail")
    sent = part.filter("text IS NOT NULL").selectExpr("key", "seq", "text", "CAST(null AS binary) ids", "CAST(null AS string) head", "CAST(null AS string) tail")

    def stitch(batches):
        own = codec(path)
        for pdf in batches:
            texts = [p["text"] for parts in pdf["parts"] for p in parts if p["text"]]
            ends = [t for parts in pdf["parts"] for p in parts for t in (p["head"], p["tail"]) if t]
            ids = iter(own.encode(texts + ends))  # new fields of all of them together
            found = [own.digests(stitched([(p["text"], next(ids) if p["text"] else p["ids"], p["head"], p["tail"]) for p in parts], own)) for parts in pdf["parts"]]
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": [f[0] for f in found], "ids_sha256": [f[1] for f in found], "decoded_sha256": [f[2] for f in found]})

    in_order = F.sort_array(F.collect_list(F.struct("seq", "text", "ids", "head", "tail"))).alias("parts")
    by_text = fetched.unionByName(sent).groupBy("key").agg(in_order)
    results = by_text.mapInPandas(stitch, "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    links = held.filter(F.col("kind") == LINK).select("doc_id", "key")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return held.filter(F.col("kind") == DONE).select(*columns).unionByName(links.join(results, "key").select(*columns))
