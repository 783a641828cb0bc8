"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's texts are cut into words (white space marks with the characters up to the next one; no piece crosses that cut),
and distinct words that the worker does not remember are encoded together: one flat array of symbols, the rank of every
adjacent pair, the minimum per word, and in each round all words merge their leftmost pairs of minimum rank at once. Several
pairs of one word merge in the same round as long as no merge makes a pair that would have come first; then the rest wait.
A word is cut once more between characters that stand side by side in no piece, as no merge crosses there; the parts take
their rounds together, so that unbroken words of a megabyte need hardly more rounds than short ones.
Words whose pairs have no rank left drop out, and the arrays are compacted. Symbols without a piece become byte pieces.

Only vocabulary files of BPE type with byte fallback, identity normalisation and kept white space are accepted.

Defined cases: a null text counts as empty, whose ids are begin and end only; texts of any length are encoded whole; repeated
rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import documents
from lumenfit.llm.registry import query

MARK = "▁"
NO_RANK = np.int64(1 << 40)
REMEMBERED = 200_000  # words a worker remembers: some 50 MB
BLOCK = 1 << 20  # characters of text whose words are encoded together
LONG_WORD = 64  # characters of a word that is remembered


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message (variable-length integers, fixed 32 and 64 bit, byte strings)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a model file, with the tables that merging and decoding need."""

    # Field numbers of the public model format; piece types; model type.
    PIECES, TRAINER, NORMALIZER = 1, 2, 3
    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    BPE = 2

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(next((list(_fields(v)) for k, v in model if k == self.TRAINER), []))
        normal = dict(next((list(_fields(v)) for k, v in model if k == self.NORMALIZER), []))
        pieces = [dict(_fields(v)) for k, v in model if k == self.PIECES]
        text = [p[1].decode() for p in pieces]
        score = np.array([np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0] for p in pieces], dtype=np.float64)
        kind = np.array([p.get(3, self.NORMAL) for p in pieces])
        if trainer.get(3) != self.BPE or not (kind == self.BYTE).sum() == 256 or normal.get(2, b""):
            raise ValueError(f"{path}: not a BPE model with byte fallback and identity normalisation")
        if normal.get(4, 1) or not normal.get(5, 1) or not normal.get(3, 1) or np.isin(kind, [self.USER_DEFINED, self.UNUSED]).any():
            raise ValueError(f"{path}: white space is removed, or there are user-defined or unused pieces")
        if any(re.search(f"[^{MARK}]{MARK}", t) for t, k in zip(text, kind) if k == self.NORMAL):
            raise ValueError(f"{path}: a piece crosses a word's end")
        self.words = self._cuts([t for t, k in zip(text, kind) if k == self.NORMAL])
        self.size = len(pieces)
        self.begin, self.end = text.index("<s>"), text.index("</s>")
        plain = np.flatnonzero(kind == self.NORMAL)
        number = {text[i]: int(i) for i in plain}
        byte_ids = np.flatnonzero(kind == self.BYTE)
        self.byte = np.empty(256, dtype=np.int64)  # id of each byte's piece
        self.byte[[int(text[i][3:5], 16) for i in byte_ids]] = byte_ids
        self.bytes = [b""] * self.size  # what each id decodes to
        for i in plain:
            self.bytes[i] = text[i].replace(MARK, " ").encode()
        self.marked = {int(i) for i in plain if text[i][0] == MARK}
        for value, i in enumerate(self.byte):
            self.bytes[i] = bytes([value])
        self.bytes[int(np.flatnonzero(kind == self.UNKNOWN)[0])] = b" \xe2\x81\x87 "
        # Characters: the id of the piece, or size + code point if there is none.
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for t, i in number.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        # Characters that stand side by side in a piece.
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for t in number for a, b in zip(t, t[1:])}), dtype=np.int64)
        # Equal scores share a rank, so that the leftmost of them wins.
        rank = np.unique(-score, return_inverse=True)[1]
        found = {}
        for t, i in number.items():
            for cut in range(1, len(t)):
                left, right = number.get(t[:cut]), number.get(t[cut:])
                if left is not None and right is not None:
                    found[left * self.size + right] = i
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.merged = np.array([found[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.rank = rank[self.merged].astype(np.int64)
        bits = 22
        self.may = np.zeros(1 << bits, dtype=bool)  # a filter before the search
        self.shift = np.uint64(64 - bits)
        self.may[self._slot(self.pairs)] = True

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern:
        """Matches the words of a text: no piece crosses from one to the next.

        A word ends before a white space mark, around line feeds, and between a letter and a mark of punctuation that
        follows a letter in no piece.
        """
        letter = r"[^\W\d_]"
        joined = {p for t in pieces for p in re.findall(f"(?<={letter})[!-/:-@\\[-`{{-~]", t)}
        alone = any("\n" in t for t in pieces)
        stops = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        if alone or not stops:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        run = f"{MARK}*+[^{MARK}\\n{stops}]++(?:(?=[{MARK}\\n]|\\Z)|(?<={letter})(?=[{stops}]))"
        return re.compile(f"{run}|{MARK}*[^{MARK}\\n]+|{MARK}+|\\n+")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; no rank where there is none."""
        rank, piece = np.full(len(left), NO_RANK), np.zeros(len(left), dtype=np.int64)
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        maybe = np.flatnonzero((keys >= 0) & self.may[self._slot(keys)])
        keys = keys[maybe]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        rank[maybe[hit]], piece[maybe[hit]] = self.rank[at[hit]], self.merged[at[hit]]
        return rank, piece

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's ids end."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.char[codes]
        word = np.repeat(np.arange(len(words)), sizes)
        new = np.r_[True, (word[1:] != word[:-1]) | ~self._side_by_side(codes)]
        where = np.cumsum(new) - 1  # the part of a word that each symbol belongs to
        word = word[new]
        done_symbols, done_where = [], []
        # The pair of symbol i is (i, i + 1); the last symbol of a word has none.
        rank, piece = self._ranks(symbols, where)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_ = np.repeat(least < NO_RANK, counts)
            if not open_.all():  # words without a pair are finished
                done_symbols.append(symbols[~open_])
                done_where.append(where[~open_])
                symbols, where, rank, piece = symbols[open_], where[open_], rank[open_], piece[open_]
                least, counts = least[least < NO_RANK], counts[least < NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, counts))
            at = self._together(at, symbols, where, rank, piece)
            # Merge: the left symbol becomes the piece, the right one goes.
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            merged = place[at]
            symbols, where, rank, piece = symbols[keep], where[keep], rank[keep], piece[keep]
            # Only pairs next to a merged symbol have changed.
            changed = np.zeros(len(symbols), dtype=bool)
            changed[merged] = changed[merged[merged > 0] - 1] = True
            touched = np.flatnonzero(changed)
            rank[touched], piece[touched] = self._ranks(symbols, where, touched)
        symbols, where = np.concatenate(done_symbols), np.concatenate(done_where)
        order = np.argsort(where, kind="stable")
        return self._with_bytes(symbols[order], word[where[order]], len(words))

    def _side_by_side(self, codes: np.ndarray) -> np.ndarray:
        """Whether some piece has each character and the next one in that order."""
        keys = codes[:-1] << 21 | codes[1:]
        if not len(self.beside):
            return np.zeros(len(keys), dtype=bool)
        return self.beside[np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)] == keys

    def _ranks(self, symbols: np.ndarray, where: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(symbols)) if at is None else at
        rank, piece = np.full(len(at), NO_RANK), np.zeros(len(at), dtype=np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[where[at[inner]] == where[at[inner] + 1]]
        rank[inner], piece[inner] = self.look_up(symbols[at[inner]], symbols[at[inner] + 1])
        return rank, piece

    def _together(self, at: np.ndarray, symbols: np.ndarray, where: np.ndarray, rank: np.ndarray,
                  piece: np.ndarray) -> np.ndarray:
        """Of the pairs of minimum rank those that merge in this round, as if merged one by one from the left."""
        if len(at) == 1:
            return at
        # Overlapping pairs stand one after the other: every second of such a run merges.
        new_run = np.r_[True, (np.diff(at) != 1)]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        again = np.r_[False, where[at[1:]] == where[at[:-1]]]  # not its word's first
        if not again.any():
            return at
        # Would a merge make a pair that comes before the word's next one? Then the next ones wait.
        made, own = piece[at], rank[at]
        before, after = at - 1, at + 2
        has_before = (before >= 0) & (where[np.maximum(before, 0)] == where[at])
        has_after = (after < len(symbols)) & (where[np.minimum(after, len(symbols) - 1)] == where[at])
        left = symbols[np.maximum(before, 0)]
        beside = np.r_[False, at[1:] == at[:-1] + 2]  # the left neighbour has just been merged too
        left = np.where(beside & has_before, np.r_[0, made[:-1]], left)
        left_rank, _ = self.look_up(left, made)
        right_rank, _ = self.look_up(made, symbols[np.minimum(after, len(symbols) - 1)])
        first = (has_before & (left_rank <= own)) | (has_after & (right_rank <= own))
        # Merges up to a word's first such merge, itself included.
        total = np.cumsum(first) - first
        word_start = np.maximum.accumulate(np.where(~again, np.arange(len(at)), 0))
        return at[total - total[word_start] == 0]

    def _with_bytes(self, symbols: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            raw = ["".join(map(chr, [c])).encode() for c in (symbols[odd] - self.size).tolist()]
            counts = np.ones(len(symbols), dtype=np.int64)
            counts[odd] = [len(r) for r in raw]
            from_byte = np.repeat(symbols >= self.size, counts)
            symbols, where = np.repeat(symbols, counts), np.repeat(where, counts)
            symbols[from_byte] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return symbols.astype(np.uint32), np.cumsum(np.bincount(where, minlength=n))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces and bytes joined, without the white space mark that encoding puts in front."""
        ids = ids.tolist()
        raw = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if i not in (self.begin, self.end)), self.begin)
        return _readable(raw[1:] if first in self.marked else raw)


def _readable(raw: bytes) -> str:
    """UTF-8, with a replacement character for each byte that is no part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in raw.decode(errors="surrogateescape"))



class Encoder:
    """Encodes texts with a vocabulary and remembers the ids of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        v = self.vocabulary
        cut = [v.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(self.known))
        ids, ends = v.encode_words(fresh)
        raw = ids.astype("<u4").tobytes()
        bounds = [0, *(4 * ends).tolist()]
        now = {w: raw[a:b] for w, a, b in zip(fresh, bounds, bounds[1:])}
        full = len(self.known) + len(now) > REMEMBERED
        self.known.update(now)
        get = self.known.__getitem__
        begin, end = (np.array([i], "<u4").tobytes() for i in (v.begin, v.end))
        out = [np.frombuffer(b"".join([begin, *map(get, words), end]), "<u4") for words in cut]
        if full:
            self.known = {w: i for w, i in now.items() if len(w) <= LONG_WORD}
        else:
            for w in [w for w in fresh if len(w) > LONG_WORD]:
                del self.known[w]
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, kept between its tasks."""
    return Encoder(Vocabulary(path))


def blocks(texts: Iterator[str], size: int = BLOCK) -> Iterator[list[str]]:
    """Texts in lists of about ``size`` characters, longer texts alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every row's text, begin and end included, and the text they decode to."""
    return _encode(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda v, ids: (ids.astype(np.int32), v.decode(ids)))


def encoded_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: digests of the ids and of the text they decode to."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(v: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()

    return _encode(docs, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def _encode(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, describe) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            at = 0
            for texts in blocks(t.as_py() or "" for t in b.column("text")):
                rows = [describe(encoder.vocabulary, ids) for ids in encoder.encode(texts)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), *made], ["doc_id", *names])
                at += len(texts)

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {columns}")


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir))
