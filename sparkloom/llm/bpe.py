"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A word's merges are not replayed.  An Aho-Corasick automaton over the vocabulary gives the longest
token that starts at each place; tokens are laid from left to right, longest first, and a token is taken
only if it is compatible with the one before: if merging the two tokens' text would leave exactly
these two.  Where nothing fits, the last token is taken back and its place is never tried again, so
the work is linear in the word.  Merging a text yields the one sequence whose neighbours are all compatible.

Compatibility needs no merging either: the seam between two tokens is followed through the
pieces of which each was merged, latest merge first; the pair is refused if at any time the
pieces at the seam would have been merged before the merge that is being undone.

Scale: rows are encoded and decoded where they lie, without a shuffle.  The vocabulary is a parameter of
checked size, sent to the executors.  Common words are kept in a table of bounded size a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The largest vocabulary file that is sent to the executors.
LARGEST_FILE = 50_000_000
#: Words of at most so many bytes are remembered, at most so many of them; likewise pairs of tokens.
SHORT_WORD, REMEMBERED = 48, 300_000
#: Texts of more characters are cut into words one at a time.
LONG_TEXT = 2_000_000
#: Tokens and rows of a batch.
BATCH_TOKENS, BATCH_ROWS = 500_000, 512

#: The steps before the merges that this codec has.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers that the regex package knows and the tokenizers library doesn't (Unicode 17 and later).
LATE = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Lower case of letters that Python 3.13 doesn't know yet (Unicode 16 and 17): first, last, distance.
LATE_LOWER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))

_late = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATE.split()) + "]"
_LATE_LOWER = {x: x + d for a, b, d in LATE_LOWER for x in range(a, b + 1)}
_UPPER = re.compile("[" + "".join(map(chr, _LATE_LOWER)) + "]")
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
_LETTER, _NUMBER, _OTHER = rf"[\p{{L}}--{_late}]", rf"[\p{{N}}--{_late}]", rf"[^\s[[\p{{L}}\p{{N}}]--{_late}]]"
#: WORDS with the alternatives that can't meet in another order, and late characters as what they are to the library.
_WORDS = regex.compile(f"(?V1){_LETTER}+|{_SUFFIX}|{_NUMBER}|{_OTHER}+")


def _low_class(kind: str) -> str:
    """The characters below U+10000 of a class of the regex package, as a class of re, which is twice as fast."""
    found = sorted(map(ord, regex.findall("(?V1)" + kind, "".join(chr(x) for x in range(0x10000) if not 0xD800 <= x <= 0xDFFF))))
    starts = [x for k, x in enumerate(found) if not k or found[k - 1] != x - 1]
    ends = [x for k, x in enumerate(found) if k == len(found) - 1 or found[k + 1] != x + 1]
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in zip(starts, ends, strict=True)) + "]"


_LOW_WORDS = re.compile(f"{_low_class(_LETTER)}+|{_SUFFIX}|{_low_class(_NUMBER)}|{_low_class(_OTHER)}+")
_ASCII_WORDS = re.compile(rf"[a-z]+|{_SUFFIX}|[0-9]|[^a-z0-9\x09-\x0D\x20]+")  # of lower-cased text


def shown_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary files of byte-level tokenizers: printable
    ones of Latin-1 for themselves, the others in order from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Words(dict):
    """The ids of words, remembered up to a number of them."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        found = self.codec.word(data)
        if len(data) <= SHORT_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encodes and decodes with a vocabulary file of the tokenizers library: BPE over bytes with a word end."""

    _made: dict[str, Codec] = {}

    def __init__(self, file: bytes):
        d = json.loads(file)
        m, pre = d["model"], d.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        if d.get("normalizer") != NORMALIZER or first.get("pattern", {}).get("Regex") != WORDS or d.get("decoder") or m["type"] != "BPE" or not m.get("end_of_word_suffix"):
            raise ValueError("not a vocabulary of words with word ends, or with other steps before the merges")
        end, shown = m["end_of_word_suffix"], shown_bytes()
        vocab = m["vocab"]

        def symbols(token: str) -> str:
            """A symbol a byte; those of the last byte of a word are 256 higher."""
            last = token.endswith(end) and len(token) > len(end)
            body = [shown[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last)

        n = max(vocab.values()) + 1
        #: The two pieces of which each token was merged; a symbol is its own.  Ids grow with the rank of merges.
        self.left, self.right = list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], int] = {}
        before = -1
        for x in m["merges"]:
            a, b = (vocab[y] for y in (x if isinstance(x, list) else x.split(" ")))
            c = vocab["".join(x) if isinstance(x, list) else x.replace(" ", "")]
            if c <= max(a, b, before):
                raise ValueError("ids must grow with the rank of their merges")
            self.left[c], self.right[c], self.merged[a, b], before = a, b, c, c
        self.size = [0] * n
        find = ahocorasick.Automaton()
        place = {}
        for token, i in vocab.items():
            s = symbols(token)
            self.size[i], place[s] = len(s), i
            find.add_word(s, i)
        find.make_automaton()
        self.find = find
        #: The longest token that a token begins with, other than itself; -1 for none.
        self.shorter = [-1] * n
        for s, i in place.items():
            self.shorter[i] = next((place[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in place), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words = Words(self)
        added = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in d.get("added_tokens", [])):
            raise ValueError("added tokens must be taken as they stand")
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        # the offset table: tokens' bytes one after another, a space behind each
        strings = [b""] * (max([n - 1, *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            strings[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)

    @classmethod
    def get(cls, file: bytes) -> Codec:
        key = hashlib.md5(file).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(file)
        return cls._made[key]

    def fits(self, a: int, b: int) -> bool:
        """Merging the text of a and b leaves exactly these two tokens."""
        if len(self.compatible) >= REMEMBERED:
            self.compatible.clear()
        found = self.compatible[a, b] = self._seam(a, b)
        return found

    def _seam(self, a: int, b: int) -> bool:
        left, right, merged = self.left, self.right, self.merged
        undone = len(left)  # merges from this id on are taken back; those before it happen first
        while True:
            if merged.get((a, b), undone) < undone:
                return False
            # the later merge of the two is undone; of two of one rank, the one on the right came later
            if a > b and right[a] != a:
                undone, a = a, right[a]
            elif right[b] != b:
                undone, b = b + 1, left[b]
            elif right[a] != a:
                undone, a = a, right[a]
            else:
                return True

    def word(self, data: bytes) -> tuple[int, ...]:
        """The ids of one word's bytes."""
        s = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        n = len(s)
        longest = [0] * n
        for last, i in self.find.iter(s):
            longest[last + 1 - size[i]] = i  # places come in order, so the longest stays
        if size[longest[0]] == n:
            return (longest[0],)
        closed: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            if token < 0:  # nothing fits here: not this place
                closed.add(at)
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
            elif at + size[token] not in closed and (before < 0 or (compatible[before, token] if (before, token) in compatible else self.fits(before, token))):
                out.append(token)
                before = token
                at += size[token]
                if at == n:
                    return tuple(out)
                token = longest[at]
                continue
            token = shorter[token]

    def _plain(self, text: str) -> Iterable[tuple[int, ...]]:
        """The ids of each word of a text without special tokens."""
        pattern = _ASCII_WORDS
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lower-cased one by one, sigma too
            if _UPPER.search(text):
                text = text.translate(_LATE_LOWER)
            pattern = _WORDS if max(text) > "\uffff" else _LOW_WORDS
        text = text.lower()
        words = pattern.findall(text) if len(text) <= LONG_TEXT else (x[0] for x in pattern.finditer(text))
        return map(self.words.__getitem__, words)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; null as empty."""
        if not text:
            return np.zeros(0, np.int32)
        if self.cut and "<" in text:
            pieces = self.cut.split(text)
            each = chain.from_iterable([(self.added[x],)] if k % 2 else self._plain(x) for k, x in enumerate(pieces))
        else:
            each = self._plain(text)
        return np.fromiter(chain.from_iterable(each), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens as they stand in the vocabulary, a space between; unknown ids are skipped."""
        out = []
        for at in range(0, len(ids), BATCH_TOKENS):
            i = ids[at : at + BATCH_TOKENS].astype(np.int64)
            i = i[(i >= 0) & (i < len(self.offsets) - 1)]
            begin, n = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out)[:-1]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file at `path`, of a checked size, for the executors."""
    with open(path, "rb") as f:
        file = f.read(LARGEST_FILE + 1)
    if len(file) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    Codec(file)  # refused here rather than in a task
    return spark.sparkContext.broadcast(file)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def _free(names: list[str], wanted: str) -> str:
    """`wanted`, with underscores behind it until no column is called so."""
    taken = {x.lower() for x in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def encode(docs: DataFrame, codec: Broadcast, text: str = "text") -> DataFrame:
    """The rows of docs with `ids`, array<int>, in place of the text column; all other columns stay (one
    called ids keeps its name, and the new one is ids_).

    Null or empty text, or nothing but white space: no ids.  Special tokens' strings inside a text are
    special tokens, as the library has it by default.  Repeated rows are rows of their own; no rows: no rows.
    """
    rest = [f for f in docs.schema.fields if f.name.lower() != text.lower()]
    ids = _free([f.name for f in rest], "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec.get(codec.value)
        for whole in batches:
            first, held, n = 0, [], 0
            for k, x in enumerate(whole.column(whole.num_columns - 1)):
                held.append(c.encode(x.as_py()))
                n += len(held[-1])
                if n >= BATCH_TOKENS or len(held) == BATCH_ROWS or k == whole.num_rows - 1:
                    b = whole.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(held)], [*b.schema.names[:-1], ids])
                    first, held, n = k + 1, [], 0

    return docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{text}`")).mapInArrow(run, StructType([*rest, StructField(ids, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, codec: Broadcast, ids: str = "ids") -> DataFrame:
    """The rows of encoded with `decoded`, the tokens' strings with a space between.  Null or no ids: empty;
    ids that the vocabulary hasn't, and nulls, are skipped.  No rows: no rows."""
    new = _free(encoded.columns, "decoded")
    at = [x.lower() for x in encoded.columns].index(ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec.get(codec.value)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(k, BATCH_ROWS)
                texts = [c.decode((x.values.fill_null(-1).to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64))) for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, new])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(new, StringType())]))


def digest(text: Column) -> Column:
    """SHA-256 of a string's UTF-8, lower-case hex."""
    return F.sha2(text.cast("binary"), 256)
