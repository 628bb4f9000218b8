"""Byte-pair encoding and decoding of whole texts, in batched numpy merge rounds.

A slice of texts becomes one array of code points; character classes cut it into words (letters, single digits,
other marks, and the contractions of the vocabulary's pattern).  Equal words of a slice are merged once: the symbols
of all distinct words lie in one flat array.  Every adjacent pair is looked up by binary search over the sorted pair
keys; in every round each word merges all places of its lowest-rank pair, from left to right, and only pairs next
to a merge are looked up again.  Words without a pair left leave the array.  A merge's parts come from earlier merges
(checked on loading), so a word's lowest rank rises from round to round and the result is that of one merge at a time.

The vocabulary is a ``tokenizers`` file of the kind "lower case, white space dropped, byte symbols, word-end mark"; a
file with another normalizer, splitter or model option is refused.  Strings of its special tokens in a text are
these tokens.  It has no decoder, so decoding joins the tokens' own strings by one space; unknown ids are left out.

Null and empty texts have no ids, and null or empty ids decode to an empty text.  Rows are independent: null or
repeated ids and equal rows need no care, an empty table gives an empty result, and a column of the result's name is
replaced.  Memory is bounded by ``SLICE_BYTES`` of text and ``SLICE_IDS`` ids, or by the longest text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

SLICE_BYTES, SLICE_IDS = 2 * tx.SLICE_BYTES, 1 << 20
NO_PAIR = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, OTHER = range(4)

# What this kind of vocabulary file does to a text before merging.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and which ones are newer than Python's tables: of these the library tells the class."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out, strange = np.full(0x110000, OTHER, np.uint8), np.zeros(0x110000, bool)
    major = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    for c in (*range(0x40000), *range(0xE0000, 0xE1000)):  # planes 4 to 13 are empty, the last two are for private use
        kind = unicodedata.category(chr(c))
        out[c] = major.get(kind[0], OTHER)
        strange[c] = kind == "Cn"
    out[[*range(0x09, 0x0E), 0x85]] = SPACE
    points = np.flatnonzero(strange)
    new = "".join(map(chr, points))
    for pattern, kind in ((r"[\p{L}]+", LETTER), (r"[\p{N}]+", DIGIT), (r"\s+", SPACE)):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(new):
            out[points[a:b]] = kind
    return out, strange


class Vocabulary:
    """Tables of one vocabulary file: symbols of bytes, sorted pair keys, and the tokens' strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        steps = [s["type"] for s in (held["normalizer"] or {}).get("normalizers", [])]
        splits = (held["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if steps != NORMALIZER or splits[0].get("pattern") != {"Regex": PATTERN} or held["decoder"] or model["type"] != "BPE" or not plain:
            raise ValueError(f"{path}: not a vocabulary of lower-cased words with byte symbols")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        added = held["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        names: list[str | None] = [None] * (1 + max([*ids.values(), *self.special.values()]))
        for name, k in [*ids.items(), *self.special.items()]:
            names[k] = name
        self.names = pa.array(names, pa.string())
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + end] for s in symbols], np.int32)

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = np.full(len(names), -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge needs the outcome of a later one")
        self.kind = np.uint32 if len(names) <= 1 << 16 else np.uint64
        self.shift = self.kind(16 if self.kind is np.uint32 else 32)
        keys = self._key(left, right)
        # Of a pair that is listed twice the later place counts, as in a table that is filled in order.
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.concatenate(([True], keys[order][1:] != keys[order][:-1]))] if len(keys) else order
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.classes, self.strange = _classes()
        self.normalizer = Tokenizer.from_file(path).normalizer

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(self.kind) << self.shift) | right.astype(self.kind)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted keys; ``NO_PAIR`` where there is none."""
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once, and where each word's begin; a word is ``data[offsets[k]:offsets[k + 1]]``, none empty."""
        out = np.full(len(data), -1, np.int32)
        symbol, place = self.inner[data], np.arange(len(data))
        symbol[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        rank = np.full(len(data), NO_PAIR)
        joined = np.flatnonzero(word[1:] == word[:-1])
        rank[joined] = self.rank(symbol[joined], symbol[joined + 1])
        while len(symbol) and len(self.keys):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            done = least == NO_PAIR
            if done.any():
                out[place[done]] = symbol[done]
                symbol, place, word, rank, least = (a[~done] for a in (symbol, place, word, rank, least))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            # In a row of overlapping places of one pair every second one merges, from the left.
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            begin = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, place, word, rank = symbol[stays], place[stays], word[stays], rank[stays]
            at -= np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                beside = near + 1 < len(word)
                rank[near[~beside]] = NO_PAIR
                near = near[beside]
                same = word[near] == word[near + 1]
                rank[near[~same]] = NO_PAIR
                near = near[same]
                rank[near] = self.rank(symbol[near], symbol[near + 1])
        out[place] = symbol
        kept = out >= 0
        return out[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]

    def normal(self, text: str) -> str:
        """Composed and in lower case; the library does it for characters newer than Python's own tables."""
        if not text.isascii() and self.strange[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.normalizer.normalize_str(text)
        # Lower case is one character by itself: Python's rule for a final sigma looks at the neighbours.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts as one array of UTF-8 strings, and the word at which each text begins."""
        texts = [self.normal(t) for t in texts]
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        solid = kinds != SPACE
        begins = solid.copy()
        begins[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        mark = np.flatnonzero(begins & (points == 0x27))
        for ending in ENDINGS:
            n = len(ending)
            here = mark[mark + n < len(points)]
            for k, c in enumerate(ending):
                here = here[points[here + 1 + k] == ord(c)]
            begins[here + 1] = False
            after = here[kinds[here + n + 1] == LETTER] + n + 1 if len(here) else here
            begins[after] = True
        length = np.ones(len(points), np.uint8)
        for bound in (0x80, 0x800, 0x10000):
            length += points >= bound
        starts = np.flatnonzero(begins)
        body = points[solid].tobytes().decode("utf-32-le").encode("utf-8")
        before = np.zeros(len(points) + 1, np.int32)
        np.cumsum(length * solid, dtype=np.int32, out=before[1:])
        where = np.append(before[starts], before[-1])
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(body))
        # A text ends at its own line feed: the first after as many characters as it has.
        ends = np.flatnonzero(points == 0x0A)
        sizes = np.array([t.count("\n") for t in texts], np.int64) + 1
        return found, np.searchsorted(starts, np.concatenate(([0], ends[np.cumsum(sizes) - 1]))) if texts else np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and where each text's begin."""
        parts, owner, special = [], [], []  # plain parts, the text of each, and (parts before, id) of each special token
        for k, t in enumerate(texts):
            cut = self.find_special.split(t) if self.find_special and any(s in t for s in self.special) else [t]
            for i, part in enumerate(cut):
                if i % 2:
                    special.append((len(parts), self.special[part], k))
                else:
                    parts.append(part)
                    owner.append(k)
        words, at = self.words(parts)
        coded = words.dictionary_encode()
        data, offsets = tx.flat(coded.dictionary)
        ids, begin = self.merge(data, offsets)
        index = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(begin)[index]
        to = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(begin[:-1][index] - to[:-1], size) + np.arange(to[-1])] if len(index) else np.zeros(0, np.int32)
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.array(owner, np.int64), np.diff(to[at]))
        if special:
            flat = np.insert(flat, to[at][[p for p, _, _ in special]], [v for _, v, _ in special])
            np.add.at(counts, [k for _, _, k in special], 1)
        return flat.astype(np.int32, copy=False), np.concatenate(([0], np.cumsum(counts)))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids (each list's tokens joined by one space)."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        flat, offsets = ids.flatten(), ids.offsets.to_numpy().astype(np.int64)
        known = np.asarray(pc.fill_null(flat, -1)).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        known = np.where((known >= 0) & (known < len(self.names)), known, -1)
        names = self.names.take(pa.array(known, mask=known < 0))
        valid = np.asarray(names.is_valid())
        to = np.concatenate(([0], np.cumsum(valid)))[offsets - offsets[0]]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(to, pa.int32()), names.drop_null()), " ")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The tables of a file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns named in ``keep`` (all by default) and the ids of each text (``array<int>``)."""
    carried = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)), F.col(text_col).cast("string").alias("text"))
    fields = [source.schema[f"c{i}"] for i in range(len(carried))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for whole in batches:
            for part in tx.slices(whole, limit=SLICE_BYTES):
                flat, at = words.encode([t or "" for t in part.column("text").to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), ids], [*names, "ids"])
        tx.release()

    coded = source.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return coded.select(*(F.col(n).alias(c) for n, c in zip(names, carried)), F.col("ids").alias(ids_col))


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text of each list of ids."""
    carried = [c for c in coded.columns if c != text_col]
    source = coded.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    fields, ids = source.schema.fields, f"c{carried.index(ids_col)}"
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(ids)), 0).to_numpy()
            to, at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(to, to[at] + SLICE_IDS, "right")) - 1)
                part = b.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, words.decode(pa.concat_arrays([part.column(ids)]))], [*names, "text"])
                at = stop
        tx.release()

    out = source.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carried)), F.col("text").alias(text_col))
