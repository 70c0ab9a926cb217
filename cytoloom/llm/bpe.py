"""Byte-pair encoding and decoding by contiguous rank arrays.

A vocabulary file of the ``tokenizers`` JSON format is read as it is: its
pre-tokenisation, special tokens, merges and ids. A short word is a list of
symbols with a list of the ranks of neighbouring pairs beside it; the smallest
rank is found by scanning, its boundary deleted and the two neighbouring ranks
looked up again. Words beyond ``LONG`` symbols use a heap over the same ranks,
as scanning would be quadratic. Words repeat, so each task keeps the ids of
recent ones while it runs. Many words that are new come with a batch of texts;
they are the rows of arrays, and each step merges one pair in every row.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists

#: Symbols from which a heap replaces the scan.
LONG = 96
#: Bytes of space-delimited chunks and their ids in a generation of a task's cache (a third as many of words, which only
#: chunks that are not kept ask for), what an entry takes beside them, and characters beyond which none is kept.
KEPT, ENTRY, LONGEST = 48 << 20, 200, 256
#: Characters of texts whose new words are encoded together (the arrays for that are the most that a task holds beside its
#: cache), how few words are still encoded one by one, and the most bytes of the words in each of the arrays.
TOGETHER, FEW, WIDTHS = 1 << 20, 1_000, (8, 10, 12, 16, 32)
NONE = 1 << 60
#: Bits of a symbol's id beside its merge's rank.
BITS = 24
MASK = (1 << BITS) - 1

#: The pre-tokenisation of the byte-level format (the vocabulary file only names it).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: White space other than the space and the line feed.
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Separators that Python but not the vocabularies' patterns take for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def tangled(text: str) -> bool:
    """Whether the split of a text may differ from the splits of its chunks, each with the space before it:
    only next to longer or other white space, or at a space at the end."""
    return "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or any(c in text for c in OTHER_SPACE)


class Pairs:
    """What ``after`` holds, for arrays of pairs: a table by hashes, a pair that finds its place taken goes to the next one."""

    def __init__(self, after: list[dict[int, int]]):
        keys = np.array([a << BITS | b for a, by in enumerate(after) for b in by], np.int64)
        found = np.array([v for by in after for v in by.values()], np.int64)
        self.bits = (4 * len(keys) + 1).bit_length()
        self.keys, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        place = self.place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]], self.found[place[free]] = keys[free], found[free]  # of several the last one
            out = self.keys[place] != keys
            keys, found, place = keys[out], found[out], self.next(place[out])

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def next(self, place: np.ndarray) -> np.ndarray:
        return place + 1 & (1 << self.bits) - 1

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair, NONE where they do not merge."""
        keys = left << BITS | right
        place = self.place(keys)
        there = self.keys[place]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            place[other] = self.next(place[other])
            there = self.keys[place[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return self.found[place]


class Words(dict):
    """Ids of words as little-endian bytes, made when first asked for.

    Two generations of bounded size: when the young one is full it becomes the
    old one, and words that are asked for again come back from there, so
    frequent words stay.
    """

    def __init__(self, encode, kept: int):
        super().__init__()
        self.encode, self.kept, self.old, self.size = encode, kept, {}, 0

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self.encode(word)
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if self.size > self.kept:
            self.turn()
        self[word] = ids
        self.size += len(word) + len(ids) + ENTRY
        return ids

    def turn(self) -> None:
        self.old, self.size = dict(self), 0
        self.clear()

    def keep(self, ids: dict[str, bytes]) -> None:
        if self.size > self.kept:
            self.turn()
        self.update(ids)
        self.size += sum(map(len, ids)) + sum(map(len, ids.values())) + ENTRY * len(ids)


class RankBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.symbol = byte_symbols()
        self.first = [self.vocab[c] for c in self.symbol]
        self.last = [self.vocab[c + self.suffix] for c in self.symbol]
        none: dict[int, int] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: By the left symbol and the right one: rank and merged symbol in one number, so that the least is the next to merge.
        self.after = [none] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a = self.vocab[left]
            if self.after[a] is none:
                self.after[a] = {}
            self.after[a][self.vocab[right]] = rank << BITS | self.vocab[left + right]
        self.pairs = Pairs(self.after)
        self.first_of, self.last_of = np.array(self.first, np.int64), np.array(self.last, np.int64)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)
        self.split = regex.compile(pattern, regex.V1).findall
        self.lowers = spec["normalizer"] is not None
        self.start_caches()
        self.pieces: list[bytes] = [b""] * len(self.after)
        for token, i in self.vocab.items():
            word = token.removesuffix(self.suffix) if self.suffix else token
            self.pieces[i] = bytes(self.byte_of[c] for c in word) + (b" " if word != token else b"")
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.decimal = np.array([f"{i},".encode() for i in range(len(self.pieces))])  # of one width, filled with zero bytes

    def start_caches(self, kept: int | None = None) -> None:
        kept = KEPT if kept is None else kept
        self.words = Words(self.encode_word, kept // 3)
        self.lead = "" if self.suffix else " "  # a vocabulary with word ends drops white space
        self.chunks = Words(lambda chunk: self.pieces_of(self.lead + chunk), kept)

    def normalise(self, text: str) -> str:
        """NFC and lower case, character by character, for vocabularies that have it; their split drops white space."""
        if not self.lowers:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def encode_word(self, word: str) -> bytes:
        data = word.encode()
        parts = [self.first[b] for b in data]
        parts[-1] = self.last[data[-1]]
        ids = array("I", (self.scan if len(parts) < LONG else self.heap)(parts))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def scan(self, parts: list[int]) -> list[int]:
        after = self.after
        ranks = [after[a].get(b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = merged = least & MASK
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = after[parts[at - 1]].get(merged, NONE)
            if at < len(ranks):
                ranks[at] = after[merged].get(parts[at + 1], NONE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        n, after = len(parts), self.after
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue = [(rank, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := after[a].get(b)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            if not alive[i] or parts[i] != a or (j := right[i]) >= n or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = rank & MASK, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (rank := after[parts[x]].get(parts[y])) is not None:
                    heapq.heappush(queue, (rank, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """``encode_word`` of each."""
        if len(words) < FEW:
            return list(map(self.encode_word, words))
        out, data = [b""] * len(words), [w.encode() for w in words]
        sizes = np.array(list(map(len, data)))
        order = np.argsort(sizes, kind="stable")
        start = 0
        for width in WIDTHS:
            rows = order[start : (end := int(np.searchsorted(sizes, width, "right", order)))]
            start = end
            if len(rows):
                ids, lengths = self.merge_rows(b"".join([data[i] for i in rows.tolist()]), sizes[rows])
                ends = (4 * np.cumsum(lengths)).tolist()
                for i, a, b in zip(rows.tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
        for i in order[start:].tolist():
            out[i] = self.encode_word(words[i])
        return out

    def merge_rows(self, data: bytes, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed ids of words one after another, and how many each has; ``scan`` with a row of arrays for each word.

        A step merges the least pair of every row and deletes its right symbol; rows without a pair left leave the arrays.
        """
        n, width, values = len(lengths), int(lengths.max()), np.frombuffer(data, np.uint8)
        inside = np.arange(width) < lengths[:, None]
        parts, ranks = np.zeros((n, width), np.int64), np.full((n, width), NONE, np.int64)
        parts[inside] = self.first_of[values]
        parts[np.arange(n), lengths - 1] = self.last_of[values[np.cumsum(lengths) - 1]]
        ranks[:, :-1][inside[:, 1:]] = self.pairs.of(parts[:, :-1][inside[:, 1:]], parts[:, 1:][inside[:, 1:]])
        merged, left, live = parts.copy(), lengths.copy(), np.arange(n)
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            going = least < NONE
            if not going.all():
                merged[live[~going], : parts.shape[1]] = parts[~going]
                parts, ranks, live, at, least = parts[going], ranks[going], live[going], at[going], least[going]
            if not len(live):
                break
            row, symbol = np.arange(len(live)), least & MASK
            left[live] -= 1
            kept = np.arange(parts.shape[1]) != at[:, None] + 1
            parts, ranks = parts[kept].reshape(len(row), -1), ranks[kept].reshape(len(row), -1)
            parts[row, at] = symbol
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, parts.shape[1] - 1)
            ranks[row, before] = self.pairs.of(parts[row, before], symbol)
            # the pair to the right comes last: where there is none to the left it takes that one's place
            ranks[row, at] = np.where(at + 1 < left[live], self.pairs.of(symbol, parts[row, after]), NONE)
        return merged[np.arange(width) < left[:, None]].astype("<u4").tobytes(), left

    def pieces_of(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def chunked(self, text: str) -> tuple[str, str | None]:
        """A normalised text as a part to be split and, if not None, chunks after single spaces, which have no part in each other's splits."""
        if not self.suffix:
            first, space, chunks = (text, "", "") if tangled(text) else text.partition(" ")
            return first, chunks if space else None
        if any(c in text for c in SEPARATORS):
            return text, None
        for c in ["\n", *OTHER_SPACE]:
            if c in text:
                text = text.replace(c, " ")
        return "", text

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, chunk by chunk where that is the same."""
        first, chunks = self.chunked(self.normalise(text))
        return self.pieces_of(first) + b"".join(map(self.chunks.__getitem__, [] if chunks is None else chunks.split(" ")))

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the young generation, the words of new ones encoded together; they are kept."""
        learned = {c: ids for c in chunks if (ids := self.chunks.old.get(c)) is not None}
        new = chunks.difference(learned)
        letters = {c for c in new if c.isalpha()}  # these alone are one word, and what follows them is another
        ended = [c for c in new if c not in letters and c[:-1].isalpha()]
        stems = {c[:-1] for c in ended} - letters
        known = {c: ids for c in stems if (ids := self.chunks.get(c)) is not None}
        letters |= stems.difference(known)
        split = {c: self.split(self.lead + c) for c in new.difference(letters, ended)}
        words = list({self.lead + c for c in letters}.union({c[-1] for c in ended}, *split.values()))
        ids = dict(zip(words, self.encode_words(words)))
        known |= {c: ids[self.lead + c] for c in letters}
        learned |= {c: known[c] for c in letters} | {c: known[c[:-1]] + ids[c[-1]] for c in ended}
        learned |= {c: b"".join([ids[w] for w in its]) for c, its in split.items()}
        self.chunks.keep({c: i for c, i in learned.items() if len(c) <= LONGEST})
        return learned

    def packed_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``packed`` of each text, in order; what is new in a group of texts is learned first."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.packed_group(group)
                group, size = [], 0
        yield from self.packed_group(group)

    def packed_group(self, texts: list[str]) -> Iterator[bytes]:
        parts = [None if self.has_special(text) else self.chunked(self.normalise(text)) for text in texts]
        ids = iter(self.ids_of_chunks([part[1] for part in parts if part and part[1] is not None]))
        for text, part in zip(texts, parts):
            if part is None:
                yield self.packed(text)
            else:
                yield self.pieces_of(part[0]) + (b"" if part[1] is None else next(ids))

    def ids_of_chunks(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text of chunks with single spaces between; different chunks are looked up once and their ids gathered."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.chunks.get, chunks))
        learned = self.learn({c for c, ids in zip(chunks, found) if ids is None})
        found = [learned[c] if ids is None else ids for c, ids in zip(chunks, found)]
        sizes, at = np.array(list(map(len, found)), np.int64) // 4, coded.indices.to_numpy()
        starts, lengths = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b].tobytes()

    def has_special(self, text: str) -> bool:
        return any(token in text for token in self.special)

    def packed(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit numbers; strings of special tokens become those, nothing is added."""
        if not self.has_special(text):
            return self.plain(text)
        out, start = [], 0
        for m in self.special_at.finditer(text):
            out += [self.plain(text[start : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            start = m.end()
        return b"".join([*out, self.plain(text[start:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4

    def decimals(self, packed: bytes) -> bytes:
        """Packed ids as decimal numbers joined by commas."""
        digits = self.decimal[np.frombuffer(packed, "<u4")].view(np.uint8)
        return digits[digits > 0].tobytes()[:-1]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def read(path: str) -> RankBpe:
    """The encoder of a vocabulary file, once in each process; nothing is encoded with it itself."""
    return RankBpe(path)


def load(path: str, kept: int | None = None) -> RankBpe:
    """The encoder of a vocabulary file with caches of its own, which go with it: tasks that follow in the process may be another operator's.

    ``kept``: bytes of a generation of its caches, else ``KEPT``; ids are the same with any.
    """
    encoder = copy.copy(read(path))
    encoder.start_caches(kept)
    return encoder


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    Null text is empty text. Null ids and repeated rows give a row each; other
    columns are not read; an empty table gives an empty result.
    """

    def make():
        bpe = load(path)

        def step(docs_of, texts):
            sizes, ids_of, decoded_of = [], [], []
            for text in texts:
                packed = bpe.packed(text or "")
                sizes.append(len(packed) // 4)
                ids_of.append(hashlib.sha256(bpe.decimals(packed)).hexdigest())
                decoded_of.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist()).encode()).hexdigest())
            return docs_of, sizes, ids_of, decoded_of

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    return map_lists(rows, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the encoding itself, as array<int>; edge cases as for round_trip_digests."""

    def make():
        encode = load(path).encode
        return lambda docs_of, texts: (docs_of, [encode(t or "") for t in texts])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    return map_lists(rows, make, f"doc_id {kind}, ids array<int>")


def texts_of(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoding of arrays of ids; a null array gives a null text."""

    def make():
        decode = load(path).decode
        return lambda docs_of, ids: (docs_of, [None if i is None else decode(i) for i in ids])

    kind = dict(tokens.dtypes)[id_col]
    rows = tokens.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`"))
    return map_lists(rows, make, f"doc_id {kind}, text string")
