"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged
over, so the place between its bytes is a certain cut. Text is cut first where
the vocabulary's own splitting pattern cuts, then at the forced boundaries; each
fragment is encoded by itself and the ids are concatenated.

Nulls encode as empty texts. Texts are encoded whole; caches are bounded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow import map_texts, two

#: Entries of a worker's cache.
CACHE_ENTRIES = 500_000
#: Longer chunks are encoded but not kept.
CACHE_CHARS = 64
#: Below this code point the classes L and N of all Unicode versions in use agree.
AGREED = 0x530


def _class(kind: str) -> str:
    """The code points below AGREED of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(AGREED) if unicodedata.category(chr(c))[0] == kind)


def _spaces() -> str:
    return "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0))


_L, _N, _S = _class("L"), _class("N"), re.escape(_spaces())
#: The public splitting pattern of byte-level BPE, for texts of code points below AGREED.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
FAR = re.compile(rf"[^\x00-{chr(AGREED - 1)}]")
#: White space beside other white space or at an end: blanks and line ends then don't mark where chunks begin.
LOOSE = ("  ", " \n", "\n ", "\n\n")
OTHER_SPACES = [c for c in _spaces() if c not in " \n"]
#: The splitting pattern of the vocabulary with word ends, for lower-cased Latin-1 words.
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
MARKS = frozenset(".,;:!?)")
LATIN = re.compile(r"[\x00-\xff]*")


def loose(text: str) -> bool:
    """Whether a text has white space beside white space, at an end, or of other kinds."""
    return any(map(text.__contains__, LOOSE)) or text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, OTHER_SPACES))


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Memo(dict):
    """A bounded memo of a function of strings: of the last so many different ones, about, in two generations."""

    def __init__(self, f, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.f, self.entries, self.old = f, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= CACHE_CHARS:
            if 2 * len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_vocabulary(path: str) -> tuple[list[bytes], dict[str, int]]:
    """The bytes of each id of a byte-level vocabulary, and the ids of its special tokens."""
    spec = json.loads(open(path, "rb").read())
    back = {c: b for b, c in byte_chars().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        if i not in special.values():
            out[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        out[i] = token.encode()
    return out, special


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary (a tokenizers file). Ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.pre = self.whole.model, self.whole.pre_tokenizer
        self.chars = byte_chars()
        self.bytes_of, self.special = byte_vocabulary(path)
        inside = np.zeros(65536, bool)
        for i, b in enumerate(self.bytes_of):
            if i not in self.special.values():
                for x, y in zip(b, b[1:]):
                    inside[x << 8 | y] = True
        self.inside = inside
        self.allowed = inside.tobytes()
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.fragments = Memo(self._fragment, CACHE_ENTRIES // 5)
        self.pieces = Memo(self._piece, CACHE_ENTRIES // 2)
        self.chunks = Memo(self._chunk)

    def _chunk(self, w: str) -> bytes:
        return self._loose(w if w[:1] == "\n" else " " + w)

    def _fragment(self, s: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def cuts(self, b: bytes) -> list[int]:
        """The forced boundaries of a byte string."""
        if len(b) > 64:
            a = np.frombuffer(b, np.uint8).astype(np.int32)
            return (np.flatnonzero(~self.inside[a[:-1] << 8 | a[1:]]) + 1).tolist()
        ok = self.allowed
        return [i for i, (x, y) in enumerate(zip(b, b[1:]), 1) if not ok[x << 8 | y]]

    def _piece(self, piece: str) -> bytes:
        b = piece.encode("utf-8", "surrogatepass")
        s = b.decode("latin-1").translate(self.chars)
        if not (at := self.cuts(b)):
            return self._fragment(s)
        return b"".join(self.fragments[s[i:j]] for i, j in zip([0, *at], [*at, len(s)]))

    def _loose(self, text: str) -> bytes:
        """Any text, special tokens included."""
        if self.special_re and (m := self.special_re.search(text)):
            return self._loose(text[: m.start()]) + array("I", [self.special[m[0]]]).tobytes() + self._loose_rest(text[m.end() :])
        if FAR.search(text):  # let the library say where letters and numbers are
            parts = [text[i:j] for _, (i, j) in self.pre.pre_tokenize_str(text)]
        else:
            parts = SPLIT.findall(text)
        return b"".join(map(self.pieces.__getitem__, parts))

    def _loose_rest(self, text: str) -> bytes:
        out = []
        while m := self.special_re.search(text):  # no recursion: a text may hold thousands of them
            out += [self._loose(text[: m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            text = text[m.end() :]
        return b"".join([*out, self._loose(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if loose(text) or self.special_re and self.special_re.search(text):
            return self._loose(text)
        first, *rest = text.replace("\n", " \n").split(" ")  # each blank or line end now begins a word, so chunks are independent
        return self._loose(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: The bytes of lower-case Latin-1 words, and the bytes that stand for them at a word's end: none of those occurs in such words.
INNER = [*range(97, 123), *range(0x80, 0xC0), 0xC2, 0xC3]
LAST = {b: bytes([b - 32 if b < 128 else b - 128]) for b in INNER if b < 0xC0}
LAST_OF = np.array([LAST[b][0] if b in LAST else 0 for b in range(256)], np.uint8)
#: Longer words go to the library: ranks take time with the square of the length.
RANK_CHARS = 64
#: Latin-1 letters and at most one mark, as a pattern of Arrow's.
PLAIN = r"^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[.,;:!?)]?$"
#: Plain words that are encoded in a row: more bytes at once take longer, fewer take more calls.
ROW = 4


def word_ranks(path: str, model):
    """The rank form of a vocabulary with word ends, as a function of the bytes of a lower-case Latin-1 word whose last one is in its form of LAST; None where it wouldn't give the library's ids.

    Merging the pair whose token has the least id is what the library does if ids
    follow the merges, no token has two, and each token is what its own text becomes:
    up to a token's rank, merges within its span are those of its text by itself.
    """
    import tiktoken

    spec = json.loads(open(path, "rb").read())["model"]
    vocab, pairs = spec["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["merges"]]
    merges, place = [a + b for a, b in pairs], {m: i for i, m in enumerate(pairs)}
    ids = [vocab[m] for m in merges]
    if spec["end_of_word_suffix"] != "</w>" or any(x >= y for x, y in zip(ids, ids[1:])):
        return None
    chars, ranks, never = byte_chars(), {}, len(pairs)

    def merged(token: str) -> bool:
        """Whether a token without a word end is what its characters become."""
        x = list(token)
        while len(x) > 1:
            k = min(range(len(x) - 1), key=lambda i: place.get((x[i], x[i + 1]), never))
            if (x[k], x[k + 1]) not in place:
                return False
            x[k : k + 2] = [x[k] + x[k + 1]]
        return True

    back = {chars[b]: b for b in INNER}
    for token in (*chars.values(), *(c + "</w>" for c in chars.values()), *merges):
        end = token.endswith("</w>")
        at = [back.get(c) for c in token.removesuffix("</w>")]
        if None not in at and not (end and at[-1] not in LAST):
            ranks[bytes(at[:-1]) + LAST[at[-1]] if end else bytes(at)] = vocab[token]
            if not ([t.id for t in model.tokenize(token.removesuffix("</w>"))] == [vocab[token]] if end else merged(token)):
                return None
    unused = max(vocab.values()) + 1
    for b in range(256):
        ranks.setdefault(bytes([b]), unused + b)
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordBpe:
    """A BPE vocabulary with word ends, which drops white space: words between blanks are independent, and each distinct one is encoded once, by ranks or by the library. Many texts are encoded together: most of their distinct words are rare, and Arrow finds and numpy places them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.chars = self.whole.model, byte_chars()
        self.words, self.pieces = Memo(self._word), Memo(self._own, CACHE_ENTRIES // 5)
        self.ranks = word_ranks(path, self.model)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        marks = {ord(m): np.frombuffer(self._piece(m), "<u4") for m in MARKS}
        self.together = self.ranks is not None and all(len(x) == 1 for x in marks.values())
        self.mark = np.full(256, -1, np.int64)
        if self.together:
            self.mark[list(marks)] = np.concatenate(list(marks.values()))

    def _letters(self, w: str) -> bytes:
        """One piece of Latin-1 letters."""
        if self.ranks is None or len(w) > RANK_CHARS:
            return self._piece(w.lower())
        b = w.lower().encode()
        return array("I", self.ranks(b[:-1] + LAST[b[-1]])).tobytes()

    def _piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _own(self, piece: str) -> bytes:
        return self._letters(piece) if piece.isalpha() else self._piece(piece)

    def _word(self, w: str) -> bytes:
        if w[-1:] in MARKS and (own := w[:-1]).isalpha():
            return (self.words.get(own) or self.words.old.get(own) or self._word(own)) + self.pieces[w[-1]]  # rare words aren't kept twice
        if w.isalpha() and (w.isascii() or LATIN.fullmatch(w)):
            return self._letters(w)
        if "<|" in w or not LATIN.fullmatch(w):  # special tokens, composition, case beyond Latin-1
            return array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, WORD_SPLIT.findall(w.lower())))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one after the other, and how many each has. Some are encoded in a row: no token of the rank form goes beyond a word's end."""
        lower = pc.utf8_lower(words)
        at = np.frombuffer(lower.buffers()[1], np.int32)[: len(lower) + 1].astype(np.int64)
        b = np.frombuffer(lower.buffers()[2], np.uint8)[: at[-1]].copy()
        mark = self.mark[b[at[1:] - 1]]
        marked = mark >= 0
        last = at[1:] - 1 - marked
        b[last] = LAST_OF[b[last]]
        inner = np.ones(len(b), bool)
        inner[at[1:][marked] - 1] = False
        at[1:] -= np.cumsum(marked)
        raw, ids, of = b[inner].tobytes(), array("I"), [*at[:-1:ROW].tolist(), int(at[-1])]
        for i, j in zip(of, of[1:]):
            ids.extend(self.ranks(raw[i:j]))
        x = np.frombuffer(ids, "<u4")
        cut = np.flatnonzero(self.ends[x]) + 1
        n = np.diff(cut, prepend=0)
        if len(n) != len(words):
            raise ValueError("a word's end is lost")
        return np.insert(x, cut[marked], mark[marked]), n + marked

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of some texts."""
        if not self.together:
            return [np.frombuffer(self.encode(t), "<u4") for t in texts.to_pylist()]
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        words, place = found.dictionary, found.indices.to_numpy()
        plain = pc.and_(pc.less_equal(pc.binary_length(words), RANK_CHARS), pc.match_substring_regex(words, PLAIN))
        own = plain.to_numpy(zero_copy_only=False)
        n = np.zeros(len(words), np.int64)
        flat = np.zeros(0, "<u4")
        if own.any():
            flat, n[own] = self._plain(words.filter(plain))
        other = [self.words[w] for w in words.filter(pc.invert(plain)).to_pylist()]
        n[~own] = [len(x) // 4 for x in other]
        first = np.empty(len(words), np.int64)
        first[own] = np.cumsum(n[own]) - n[own]
        first[~own] = len(flat) + np.cumsum(n[~own]) - n[~own]
        flat = np.concatenate([flat, np.frombuffer(b"".join(other), "<u4")])
        out, word = [], np.r_[0, np.cumsum(parts.value_lengths().to_numpy())]
        for k in range(0, len(texts), 256):  # a few texts at once, whose places take eight bytes an id
            ends = word[k : k + 257]
            p = place[ends[0] : ends[-1]]
            size = n[p]
            stop = np.cumsum(size)
            ids = flat[np.repeat(first[p] - stop + size, size) + np.arange(int(size.sum()))]
            out += np.split(ids, np.r_[0, stop][ends[1:-1] - ends[0]])
        return out


def lists(parts: list[bytes]) -> pa.ListArray:
    """Ids as a list array."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_documents(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text; null and empty texts have none. Repeated rows stay."""
    def make():
        bpe = forced_boundary(vocab)

        def f(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists([bpe.encode(t) for t in texts])], ["doc_id", "ids"])

        return f

    return map_texts(two(df, id_col, text_col), make, "doc_id bigint, ids array<int>")


def decode_documents(df: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text of each list of ids; null lists give empty texts. Bytes that aren't UTF-8 become U+FFFD."""
    def run(batches):
        bpe = forced_boundary(vocab)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bpe.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


class RankBpe:
    """The same ids as ForcedBoundaryBpe, for operators that only need them fast: by the rank form of the vocabulary. Texts with special tokens, with letters that Unicode versions class differently, or with very long runs of blanks go the exact way."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        bytes_of, special = byte_vocabulary(path)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(bytes_of) if i not in special.values()}, special_tokens={})

    @property
    def exact(self) -> ForcedBoundaryBpe:
        """Loaded only where a text needs it."""
        return forced_boundary(self.path)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or FAR.search(text):
            return self.exact.encode(text)
        try:
            if len(text) < 100_000:  # a list is faster, but takes more memory
                return array("I", self.ranks.encode_ordinary(text)).tobytes()
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # a run of blanks too long for the pattern's stack
            return self.exact.encode(text)


# A worker process serves many tasks: it loads a vocabulary once and keeps its bounded caches.
@lru_cache(maxsize=2)
def forced_boundary(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


@lru_cache(maxsize=2)
def rank_bpe(path: str) -> RankBpe:
    return RankBpe(path)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
