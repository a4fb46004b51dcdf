"""Byte-pair encoding with forced boundaries: cuts at byte pairs that no vocabulary token contains."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from codexmill.llm.common import released, values

#: The pattern by which byte-level vocabularies of this kind split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids each generation of a worker's memos keeps, of at most 64 characters; the memos never change a result.
MEMO_ROWS = 250_000
#: Bytes of text whose distinct pieces are found together; a longer text is encoded by itself.
RUN_BYTES = 8 << 20


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """Packed ids of pieces that stand after a fixed character, or of fragments. Two generations of bounded size; the memo never changes a result."""

    def __init__(self, encode, before: str) -> None:
        super().__init__()
        self.encode, self.before, self.older = encode, before, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.encode(self.before, piece) if self.before or piece else b""
        if len(piece) <= 64:
            if len(self) > MEMO_ROWS:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class ByteBpe:
    """Encoder and decoder of one vocabulary file: byte-level BPE without normaliser, prefix space or dropout."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: to_bytes(t) for t, i in model["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        ids = model["vocab"]
        ids_of = {to_bytes(t): i for t, i in ids.items()}
        ranks = {bytes([b]): b for b in range(256)}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(to_bytes(a + b), len(ranks))
        engine = tiktoken.Encoding("fragments", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.merge_ranks = engine._core_bpe.encode_single_piece
        self.code = "H" if max(self.bytes_of) < 1 << 16 else "I"
        #: Packed id of each rank, and of each fragment that is a token by itself: the engine gives it its own rank.
        self.packed = [self._pack([ids_of[t]]) for t in sorted(ranks, key=ranks.get)]
        self.packed_of = {t: self.packed[r] for t, r in ranks.items()}
        inside = {pair for t in map(to_bytes, ids) for pair in zip(t, t[1:])}
        #: Where these two bytes meet, no merge can ever span them.
        self.cut_pairs = frozenset((a, b) for a in range(256) for b in range(256)) - inside
        self.cuts = np.ones((256, 256), bool)
        self.cuts[tuple(np.array(sorted(inside), int).reshape(-1, 2).T)] = False
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.bare, self.spaced, self.broken = (_Memo(self._piece, before) for before in ("", " ", "\n"))
        self.fragments = _Memo(self._fragment, "")

    def _encode_pretoken(self, raw: bytes) -> bytes:
        """Cuts at the forced boundaries, merges each fragment alone, lowest rank first, concatenates."""
        cut, packed = self.cut_pairs, self.packed
        if cut.isdisjoint(zip(raw, raw[1:])):
            return b"".join([packed[r] for r in self.merge_ranks(raw)])
        out, whole, begin = [], self.packed_of, 0
        for at, pair in enumerate(zip(raw, raw[1:]), 1):
            if pair in cut:
                out.append(raw[begin:at])
                begin = at
        out.append(raw[begin:])
        return b"".join([whole[f] if f in whole else b"".join([packed[r] for r in self.merge_ranks(f)]) for f in out])

    def _piece(self, before: str, piece: str) -> bytes:
        """Packed ids of a piece after a fixed character. What the pattern splits it into goes by the memos too: a word with a comma finds the word."""
        if before != "\n":
            if piece.isalpha():
                return self._encode_pretoken((before + piece).encode())
            if piece[-1:] in _STOPS and piece[:-1].isalpha():  # the pattern cuts nowhere but before the stop
                return (self.spaced if before else self.bare)[piece[:-1]] + self.bare[piece[-1]]
        whole = before + piece
        parts = self.split(whole)
        if len(parts) > 1:
            return b"".join([self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in parts])
        return self._encode_pretoken(whole.encode())

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _encode_plain(self, text: str) -> bytes:
        """Where no white space meets white space, the pattern never looks past the place before a white-space character, so the text falls into pieces there."""
        if _doubled(text):
            return b"".join(map(self.bare.__getitem__, self.split(text)))
        out: list[bytes] = []
        first, spaced = self.bare, self.spaced.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head])
            out += map(spaced, rest)
            first = self.broken
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids of the whole text as native unsigned integers of `code`. The strings of special tokens become their ids; none are added."""
        if self.special and any(s in text for s in self.special):
            parts = self.special_split(text)
            return b"".join(self._pack([self.special[p]]) if p in self.special else self._encode_plain(p) for p in parts)
        return self._encode_plain(text)

    def encode_column(self, texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[bytes]:
        """encode_packed of every text of an Arrow column; null counts as empty. A run of texts is cut into pieces in Arrow, and only
        its distinct pieces become Python strings; texts that fall into no such pieces go one by one."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + run_bytes, side="right")))
            run = texts.slice(at, stop - at).fill_null("")
            if ends[stop - 1] - before > run_bytes:
                yield self.encode_packed(run[0].as_py())
            else:
                yield from self._encode_run(pa.concat_arrays([run.cast(pa.string())]))
            at = stop

    def _encode_run(self, texts: pa.StringArray) -> Iterator[bytes]:
        odd = _odd(texts)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        data, offsets = _bytes(plain)
        begins = _SPACES[data]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        stream, ends = _bytes(self._encode_pieces(found.dictionary).take(found.indices))
        stream, ends = stream.tobytes(), ends[np.searchsorted(starts, offsets)].tolist()
        at = 0
        for i, alone in enumerate(odd.tolist()):
            if alone:
                yield self.encode_packed(texts[i].as_py())
            else:
                yield stream[ends[at] : ends[at + 1]]
                at += 1

    def _encode_pieces(self, pieces: pa.BinaryArray) -> pa.BinaryArray:
        """Packed ids of distinct pieces. Words of Latin letters, with a stop or without, are cut at the forced boundaries all at once,
        and only their distinct fragments are merged; other pieces go by the memos."""
        data, offsets = _bytes(pieces)
        if not len(data):
            return pieces
        starts, lasts = offsets[:-1], offsets[1:] - 1
        sign = _SPACES[data[starts]]
        first = starts + sign
        stop = _STOP_BYTES[data[lasts]] & (lasts > first)
        letters = _LETTERS[data]
        wide = np.flatnonzero((data[:-1] == 0xC3) & _AFTER_C3[data[1:]])
        letters[wide] = letters[wide + 1] = True
        letters[starts[sign]] = letters[lasts[stop]] = True
        words = np.logical_and.reduceat(letters, starts) & (lasts >= first)
        begins = np.zeros(len(data), bool)
        begins[1:] = self.cuts[data[:-1], data[1:]] & np.repeat(words, np.diff(offsets))[1:]
        begins[starts] = begins[lasts[stop & words]] = True
        begins[first[words & (data[starts] == 10)]] = True  # the line feed is split from the word, a space is not
        at = np.flatnonzero(begins)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        others = np.zeros(len(found.dictionary), bool)
        others[found.indices.to_numpy()[np.searchsorted(at, starts[~words])]] = True
        packed = [self._other(f) if other else self.fragments[f] for f, other in zip(found.dictionary.to_pylist(), others.tolist())]
        stream, ends = _bytes(pa.array(packed, pa.binary()).take(found.indices))
        ends = np.append(ends[np.searchsorted(at, starts)], len(stream)).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(stream)])

    def _fragment(self, _: str, fragment: bytes) -> bytes:
        return self.packed_of.get(fragment) or b"".join([self.packed[r] for r in self.merge_ranks(fragment)])

    def _other(self, raw: bytes) -> bytes:
        piece = raw.decode()
        return self.spaced[piece[1:]] if piece[0] == " " else self.broken[piece[1:]] if piece[0] == "\n" else self.bare[piece]

    def encode(self, text: str) -> list[int]:
        """The ids of encode_packed as a list."""
        return memoryview(self.encode_packed(text)).cast(self.code).tolist()

    def decode(self, ids: list[int]) -> str:
        """The bytes of the ids as text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


#: Marks that may end a word: the pattern takes one after letters by itself.
_STOPS = frozenset(".,;:!?")
#: Two white-space characters in a row, or one of those that readers of \s disagree on.
_PAIR = re.compile(r"\s\s|[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
#: White space other than the space and the line feed, and those characters: in ASCII, and beyond.
_RARE_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
_RARE = [c for c in map(chr, range(128, 0x10000)) if c.isspace() or c in "\u180e\u200b\ufeff"]


def _doubled(text: str) -> bool:
    """Whether _PAIR finds something. Most texts have only spaces and line feeds, and finding a fixed string is quicker."""
    for c in _RARE_ASCII:
        if c in text:
            return _PAIR(text) is not None
    if not text.isascii():
        for c in _RARE:
            if c in text:
                return _PAIR(text) is not None
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


#: By byte: the space and the line feed; the other white space of _RARE_ASCII; first bytes of characters in _RARE.
_SPACES, _CONTROLS, _LEADS = (np.isin(np.arange(256), list(b)) for b in (b" \n", _RARE_ASCII.encode(), bytes(c.encode()[0] for c in _RARE)))
#: By byte: ASCII letters; second bytes of Latin letters after 0xC3; the stops.
_LETTERS, _AFTER_C3, _STOP_BYTES = (np.isin(np.arange(256), x) for x in ([b for b in range(128) if chr(b).isalpha()], [b for b in range(0x80, 0xC0) if chr(b + 0x40).isalpha()], list(map(ord, _STOPS))))
#: The first three bytes that begin with a character of _RARE, the third as 0 for characters of two, as one number.
_RARE_CODES = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in _RARE])


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings or bytes without nulls; the first offset is 0."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset).astype(np.int64) if offsets else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _odd(texts: pa.StringArray) -> np.ndarray:
    """The texts that white space does not cut into pieces: two spaces or line feeds in a row, or any other white space."""
    data, offsets = _bytes(texts)
    white = np.flatnonzero(_SPACES[data])
    second = white[1:][np.diff(white) == 1]
    leads = np.flatnonzero(_LEADS[data])
    b0, b1, b2 = (data[np.minimum(leads + k, len(data) - 1)].astype(np.int64) for k in range(3)) if len(leads) else [leads] * 3
    rare = leads[np.isin(b0 << 16 | b1 << 8 | np.where(b0 < 0xE0, 0, b2), _RARE_CODES)]
    odd = np.zeros(len(texts), bool)
    of = lambda places: np.searchsorted(offsets, places, side="right") - 1
    odd[of(second)[~np.isin(second, offsets)]] = True  # a text's first byte is not the second of a pair
    odd[of(np.flatnonzero(_CONTROLS[data]))] = True
    odd[of(rare)] = True
    return odd


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The encoder of a file, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, digests: bool = True) -> DataFrame:
    """For every row of docs: doc_id, n_tokens and, with digests, ids_sha256 and decoded_sha256, else ids and decoded.

    Null texts count as empty: no ids, empty decoded text. Repeated rows are encoded each; extra columns are ignored;
    texts of any length are encoded whole; an empty table gives an empty result."""
    schema = docs.select("doc_id").schema.add("n_tokens", "long")
    if digests:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    else:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches):
        bpe, names = load(path), {}
        for batch in batches:
            counts, a, b = [], [], []
            for text in values(batch.column(1)):
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                if digests:
                    if not names:
                        names = {i: str(i) for i in bpe.bytes_of}
                    a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    a.append(ids)
                    b.append(decoded)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])], schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(released(run), schema)
