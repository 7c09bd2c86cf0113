"""Byte-pair encoding as a bounded-lookahead streaming transducer.

A merge list fixes how far ahead of a symbol the input has to be known before the
token that covers it can no longer change.  :func:`lookahead` computes that distance
from the merges; :class:`Transducer` keeps only the undecided tail of a word plus
that many bytes, so words of any length take constant memory.  :class:`Decoder`
is the inverse state machine: ids in, text out, holding at most one unfinished
character.

Null texts count as empty, empty texts give no ids, repeated rows each give a row,
further columns of the input are left out of the result, an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import WORKER_CACHES, pieces_of

#: Entries in a generation of each worker's memo of words; two generations of 2 ** 18 take about 80 MB.
MEMO = 1 << 18
#: Longer keys are not kept.
LONG = 64
#: Characters of a text that are cut into words at once.
PART = 1 << 16
#: Bits of an id, and what is greater than any rank.
BITS, NEVER = 20, 1 << 62
#: Up to this many symbols a scan finds the next merge sooner than a heap does.
SHORT = 40
#: Few ids to bytes, by how many there are.
_pack = [struct.Struct(f"<{n}I").pack for n in range(40)]
#: White space as Unicode has it, which lacks the four separators U+001C to U+001F that str.split() cuts at.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BLANKS = regex.compile(f"[{SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and word rules of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.plain = [self.ids[alphabet[b]] for b in range(256)]
        self.last = [self.ids[alphabet[b] + self.suffix] for b in range(256)]
        self.bytes_of = {alphabet[b]: b for b in range(256)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        plain = pattern.replace(r"\s", r"\x09-\x0d\x20").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.plain_words = self.words if r"\p" in plain else re.compile(plain)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.lookahead = lookahead(merges)
        self.table = packed(merges)

    @cached_property
    def spaced(self) -> dict[int, bytes]:
        """Each id's spelling after a blank."""
        return {i: f" {t}".encode() for i, t in self.names.items()}

    @cached_property
    def text_bytes(self) -> dict[int, bytes]:
        """The bytes that each id stands for."""
        return {i: self._text(t) for i, t in self.names.items()}

    def _text(self, name: str) -> bytes:
        """The bytes that a token stands for; one that ends a word has a blank after it."""
        ends = bool(self.suffix) and name.endswith(self.suffix)
        stem = name.removesuffix(self.suffix) if ends else name
        return bytes(self.bytes_of[c] for c in stem) + b" " * ends if all(c in self.bytes_of for c in stem) else name.encode()


def packed(merges: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    """Pairs of symbols and their ranks and outcomes as single numbers."""
    return {a << BITS | b: rank << BITS | out for (a, b), (rank, out) in merges.items()}


def lookahead(merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols past a token's end that can still decide whether the token stands.

    Let a merge (s, z) of rank r need as many symbols after s as z has, and those that z's own
    forming needs, and those of any earlier merge that would take z.  A token (p, q) forms unless an
    earlier merge takes p or q for its left part, or something keeps p or q from forming; what
    reaches past p counts from p's end, so q's symbols are taken off.  Ranks only fall along such a
    chain, so one pass in rank order gives the longest.
    """
    size: dict[int, int] = {}
    forms: dict[int, int] = {}
    ranks: dict[int, list[int]] = {}
    most: dict[int, list[int]] = {}

    def taken(symbol: int, below: int) -> int:
        found = ranks.get(symbol)
        at = bisect.bisect_left(found, below) if found else 0
        return most[symbol][at - 1] if at else 0

    for (left, right), (rank, out) in sorted(merges.items(), key=lambda m: m[1][0]):
        q = size.setdefault(right, 1)
        size[out] = size.setdefault(left, 1) + q
        past_right = max(forms.get(right, 0), taken(right, rank))
        past_left = max(forms.get(left, 0), taken(left, rank)) - q
        forms[out] = max(forms.get(out, 0), past_right, past_left)
        known = most.setdefault(left, [])
        known.append(max(q + past_right, known[-1] if known else 0))
        ranks.setdefault(left, []).append(rank)
    longest = max((max(forms.get(t, 0), taken(t, NEVER)) for t in size), default=0)
    return longest + 1  # one more: a symbol is known to end its word only when the next one is missing


def merge_all(symbols: list[int], table: dict[int, int]) -> list[int]:
    """Apply the earliest merge, leftmost first, until none applies.

    ``table`` has rank and outcome of each pair, see :func:`packed`.
    """
    if len(symbols) > SHORT:
        return _merge_long(symbols, table)
    get = table.get
    found = [get(a << BITS | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
    while found:
        best = min(found)
        if best == NEVER:
            break
        at = found.index(best)
        symbols[at] = best & (1 << BITS) - 1
        del symbols[at + 1], found[at]
        if at < len(found):
            found[at] = get(symbols[at] << BITS | symbols[at + 1], NEVER)
        if at:
            found[at - 1] = get(symbols[at - 1] << BITS | symbols[at], NEVER)
    return symbols


def _merge_long(symbols: list[int], table: dict[int, int]) -> list[int]:
    """The same with a heap of merges and links between what is left."""
    n, mask = len(symbols), (1 << BITS) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(table[p] >> BITS, i, p) for i, p in enumerate(a << BITS | b for a, b in zip(symbols, symbols[1:], strict=False)) if p in table]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] < 0 or symbols[i] << BITS | symbols[j] != pair:
            continue
        symbols[i], symbols[j] = table[pair] & mask, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := symbols[i] << BITS | symbols[k]) in table:
                heapq.heappush(heap, (table[p] >> BITS, i, p))
        if (h := before[i]) >= 0 and (p := symbols[h] << BITS | symbols[i]) in table:
            heapq.heappush(heap, (table[p] >> BITS, h, p))
    return [s for s in symbols if s >= 0]


class Transducer:
    """One word at a time: feed bytes, take the ids that are final, then finish."""

    def __init__(self, vocabulary: Vocabulary, step: int = 256):
        self.v, self.held = vocabulary, bytearray()
        self.limit = vocabulary.lookahead + max(step, 1)
        self.widths: dict[int, int] = {}

    def width(self, token: int) -> int:
        """Bytes that a token covers."""
        if (w := self.widths.get(token)) is None:
            w = self.widths[token] = len(self.v.names[token].removesuffix(self.v.suffix))
        return w

    def feed(self, data: bytes) -> list[int]:
        """Ids that nothing after ``data`` can change."""
        out: list[int] = []
        for at in range(0, len(data), self.limit):
            self.held += data[at : at + self.limit]
            if len(self.held) >= 2 * self.limit:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        symbols = merge_all(list(map(self.v.plain.__getitem__, self.held)), self.v.table)
        done, n, sure = 0, 0, len(self.held) - self.v.lookahead
        for token in symbols:
            w = self.width(token)
            if done + w > sure:
                break
            done, n = done + w, n + 1
        del self.held[:done]
        return symbols[:n]

    def finish(self) -> list[int]:
        """The ids of what is still held; the word ends here."""
        held, v = self.held, self.v
        if not held:
            return []
        symbols = list(map(v.plain.__getitem__, held))
        symbols[-1] = v.last[held[-1]]
        held.clear()
        return merge_all(symbols, v.table)


class Decoder:
    """Ids to text, as they come: each id gives bytes, and bytes give characters as soon as each is complete.

    Without a decoder in its file a tokenizer joins the vocabulary's own spellings by
    spaces; with ``to_bytes`` the spellings are turned into the bytes they stand for.
    """

    def __init__(self, vocabulary: Vocabulary, to_bytes: bool = False):
        self.table = vocabulary.text_bytes if to_bytes else vocabulary.spaced
        self.skip = 0 if to_bytes else 1  # nothing parts the first spelling from what is before it
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.table.__getitem__, ids))
        if self.skip and data:
            data, self.skip = data[1:], 0
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def _packed_ids(ids: list[int]) -> bytes:
    return _pack[len(ids)](*ids) if len(ids) < len(_pack) else np.array(ids, "<u4").tobytes()


def _unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


class Memo:
    """A bounded dictionary of two generations: what was not used for a whole generation is forgotten."""

    def __init__(self, make: Callable[[Any], bytes], most: int):
        self.make, self.most = make, most
        self.young: dict[Any, bytes] = {}
        self.old: dict[Any, bytes] = {}

    def take(self, key: Any) -> bytes:
        """For a key that is not among the young."""
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value

    def each(self, keys: list) -> list[bytes]:
        get, take = self.young.get, self.take  # a generation that ends meanwhile still answers rightly
        return [v if (v := get(k)) is not None else take(k) for k in keys]


class Codec:
    """Whole texts: words are memoised, each unknown one goes through the transducer."""

    def __init__(self, path: str, memo: int = MEMO):
        self.v = Vocabulary(path)
        self.transducer = Transducer(self.v)
        self.words = Memo(self._word, memo)

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens, lower-cased."""
        if text.isascii():
            return self.v.plain_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.v.words.findall("".join(map(str.lower, text)) if "\u03a3" in text else text.lower())

    def _word(self, word: str) -> bytes:
        t = self.transducer
        ids = t.feed(word.encode("utf-8", "replace"))
        return _packed_ids(ids + t.finish() if ids else t.finish())

    def encode(self, text: str) -> Iterator[list[bytes]]:
        """The ids of the text's words, four bytes each, part after part of a long text."""
        at = 0
        while at < len(text):
            cut = _BLANKS.search(text, at + PART) if len(text) - at > PART else None
            end = cut.start() if cut else len(text)
            whole = text[at:end]
            for part in self.v.marks.split(whole) if "<|" in whole else (whole,):
                special = self.v.special.get(part)
                yield self.words.each(self.cut(part)) if special is None else [struct.pack("<I", special)]
            at = end

    def ids(self, text: str) -> list[int]:
        return _unpacked(b"".join(b"".join(some) for some in self.encode(text)))


_codecs: dict[str, Codec] = {}
WORKER_CACHES.append(_codecs)


def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` of every row: token ids and the text they decode to."""
    key = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in pieces_of(batches, "text", keep=_codecs):
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                decoder, found, back = Decoder(own.v), [], []
                for some in own.encode(text or ""):
                    part = _unpacked(b"".join(some))
                    found += part
                    back.append(decoder.feed(part))
                ids.append(found)
                texts.append("".join([*back, decoder.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key.simpleString()}, ids array<bigint>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digest_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: the digests of what :func:`encode_table` returns, made as tokens come."""
    key = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in pieces_of(batches, "text", keep=_codecs):
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                count, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(own.v)
                for some in own.encode(text or ""):
                    data = b"".join(some)
                    ids.update(data)
                    decoded.update(decoder.feed(_unpacked(data)).encode())
                    count += len(data) // 4
                decoded.update(decoder.finish().encode())
                n.append(count)
                a.append(ids.hexdigest())
                b.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
