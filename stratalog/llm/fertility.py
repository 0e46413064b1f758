"""Quality rules from public vocabularies: how their tokens fit a text.

Three measures of each text by each vocabulary, the words joined by single blanks,
so that tokens don't cross them:

- characters per token: low for symbols, capitals and made-up strings;
- byte-fallback share: tokens that are single bytes of no ASCII character, of all tokens;
- token entropy, in bits: near 0 where one token is repeated.

Each language, or script, has bands by vocabulary: a typical fertility, a typical
entropy that grows with the logarithm of the tokens, and how far a text may be from
them. Distances of fertility are taken times the root of the tokens, so that short
texts may vary more. A text outside a band of either vocabulary is rejected.

fit() finds the bands from labelled good rows, at most FIT_ROWS of them; BANDS holds
what it found on a table of four languages. Codes of languages are lower-cased and
cut at '-' or '_'. With another code, or none, a text takes the bands of its main
script where these are known; else a text of Latin letters must pass the bands of a
language whose function words it has (of any fitted language where it has none),
which also rejects good texts of Latin languages far from all of these; one of another
script takes the wide bands ``*``, which reject little.

Base rules come first: too few words, or too many in repeated 8-word windows.
Null and empty texts have no words and fail them. Rows are judged each by itself,
repeated ones alike; an empty table gives no rows. Texts are taken whole, a slice of
bytes or one text at a time.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow import slices, stored
from .substrings import covered
from .words import WORD, grams

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


class Band(NamedTuple):
    """Typical characters per token, typical entropy at one token and its growth with each doubling; least and greatest distance of fertility, least distance of entropy, greatest byte-fallback share."""

    per: float
    start: float
    growth: float
    low: float
    high: float
    entropy: float
    bytes: float


#: Labelled rows that bands are fitted on, at most; the share of good rows beyond each edge, and how much wider than that the bands are.
FIT_ROWS, BEYOND, WIDER = 20_000, 0.001, 1.4
#: Fixed values that fit() found, by language and vocabulary.
BANDS: dict[str, tuple[Band, Band]] = {
    "de": (Band(2.243, 4.693, 0.184, -4.641, 3.656, -0.935, 0.02), Band(2.308, 4.601, 0.203, -3.763, 4.065, -1.037, 0.058)),
    "en": (Band(2.219, 4.505, 0.22, -6.54, 3.99, -0.947, 0.02), Band(2.231, 4.43, 0.234, -3.919, 4.261, -0.925, 0.022)),
    "es": (Band(1.94, 4.733, 0.184, -3.862, 3.848, -0.591, 0.02), Band(2.061, 4.71, 0.186, -3.215, 3.884, -0.595, 0.04)),
    "fr": (Band(1.979, 4.986, 0.148, -6.353, 3.828, -0.666, 0.02), Band(2.038, 4.947, 0.161, -4.417, 3.816, -0.65, 0.03)),
    "*": (Band(2.1, 4.6, 0.2, -30.0, 60.0, -2.5, 0.6), Band(2.1, 4.6, 0.2, -30.0, 60.0, -2.5, 0.9)),
}
#: Frequent words that tell the fitted languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is was for that with it as on be by this are from at or you his which not have",
    "fr": "le la les des et est une un du que dans pour qui sur pas au avec ce il par ne se sont plus",
    "de": "der die und das den von zu mit ist des im dem nicht ein eine auf für als auch es sich werden bei oder",
    "es": "el la los las y que del se una por con un para es su al lo como más no sus o fue ha",
}
SPEAKS = {k: {w.encode() for w in v.split()} for k, v in FUNCTION_WORDS.items()}
#: Where the letters of scripts lie, first and last code point.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0xAC00, 0xD7A3),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF),),
}
#: The script of each 16-bit unit, by its place above and from 1; 0: of none.
SCRIPT_OF = np.zeros(1 << 16, np.uint8)
for _i, _spans in enumerate(SCRIPTS.values(), 1):
    for _first, _last in _spans:
        SCRIPT_OF[_first : _last + 1] = _i
#: Words of a worker's table, and their bytes, after which it starts again.
WORDS, WORD_BYTES = 400_000, 16 << 20
CODE_END = re.compile("[-_]")
LETTER = re.compile(r"[^\W\d_]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
MEASURES = ("n_tokens bigint", "chars_per_token double", "byte_share double", "entropy double")


class Pieces:
    """Token ids of words by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after another, and how many each has."""
        ids = self.model.encode(words, out_type=int, num_threads=1)
        n = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n


class Ranks:
    """The same by ranks of byte strings, of words after a blank."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(1 + max(ranks.values()), np.int64)
        self.byte = np.zeros(len(self.size), bool)
        for b, i in ranks.items():
            self.size[i], self.byte[i] = len(b), len(b) == 1 and b[0] > 127

    def _one(self, word: str) -> list[int]:
        try:
            return self.model.encode_ordinary(" " + word)
        except ValueError:  # a run of some white space too long for the pattern's stack
            return [i for at in range(0, len(word), 10_000) for i in self.model.encode_ordinary((" " if at == 0 else "") + word[at : at + 10_000])]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        try:
            ids = self.model.encode_to_numpy(" " + " ".join(words), disallowed_special=())
        except ValueError:
            ids = np.zeros(0, np.uint32)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        tokens = np.cumsum(self.size[ids])
        at = np.searchsorted(tokens, ends)
        if len(ids) and at[-1] < len(ids) and (tokens[at] == ends).all():
            return ids, np.diff(at, prepend=-1)
        each = [self._one(w) for w in words]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)


class WordTable(dict):
    """Places of words in arrays of their hashes and token ids. New words wait until settle() encodes them together; the table starts again when it is full."""

    def __init__(self, paths: tuple[str, ...]):
        super().__init__()
        self.vocabularies = [Pieces(p) if p.endswith(".model") else Ranks(p) for p in paths]
        self._start()

    def _start(self) -> None:
        self.clear()
        self.new, self.bytes = [], 0
        self.hash = np.zeros(0, np.uint64)
        self.ids = [np.zeros(0, np.uint32) for _ in self.vocabularies]
        self.n = [np.zeros(0, np.int64) for _ in self.vocabularies]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return i

    def places(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The places of each text's words, which the arrays then have."""
        if len(self) > WORDS or self.bytes > WORD_BYTES:
            self._start()
        out = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new:
            words = [w.decode("utf-8", "replace") for w in self.new]
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), np.uint64, len(words))])
            for k, v in enumerate(self.vocabularies):
                ids, n = v.encode(words)
                self.ids[k], self.n[k] = np.concatenate([self.ids[k], ids]), np.concatenate([self.n[k], n])
            self.new = []
        self.first = [np.cumsum(n) - n for n in self.n]
        return out

    def tokens(self, k: int, at: np.ndarray) -> np.ndarray:
        """The ids of the words at some places by the k-th vocabulary."""
        n = self.n[k][at]
        ends = np.cumsum(n)
        return self.ids[k][np.repeat(self.first[k][at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def measures(self, k: int, at: np.ndarray, chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy. A text without words has 0 of each."""
        ids = self.tokens(k, at)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(ids), chars / len(ids), float(self.vocabularies[k].byte[ids].mean()), float(-(p * np.log2(p)).sum())


@lru_cache(maxsize=2)
def shared_table(paths: tuple[str, ...]) -> WordTable:
    """The worker process's own table."""
    return WordTable(paths)


def passes(tokens: int, per: float, share: float, entropy: float, band: Band) -> bool:
    """Whether the measures lie in a band."""
    if not tokens:
        return False
    f, e = (per - band.per) * tokens**0.5, entropy - band.start - band.growth * np.log2(tokens)
    return bool(band.low <= f <= band.high and e >= band.entropy and share <= band.bytes)


def letters(t: str) -> np.ndarray:
    """The letters of each script in a text, by its place in SCRIPTS and from 1."""
    units = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16)
    return np.bincount(SCRIPT_OF[units], minlength=len(SCRIPTS) + 1)[1:]


def script(t: str) -> str:
    """The script of more letters than any other's, '' where there are none."""
    n = letters(t)
    return list(SCRIPTS)[int(n.argmax())] if n.any() else ""


def candidates(t: str, of: str, bands: dict) -> list[str]:
    """The keys of ``bands`` that judge a text of no known language and a main script: one of them must accept it."""
    if of in bands:
        return [of]
    fitted = [k for k in bands if k != "*" and k not in SCRIPTS]
    if not fitted or of not in ("latin", "") or 2 * letters(t)[0] < len(LETTER.findall(t)):
        return ["*"]
    words = WORD.findall(t.lower().encode("utf-8", "surrogatepass"))
    n = {k: sum(map(SPEAKS[k].__contains__, words)) for k in fitted if k in SPEAKS}
    most = max(n.values(), default=0)
    return [k for k in n if 2 * n[k] >= most] if most else fitted


def columns(vocabs: dict[str, str]) -> str:
    """The measures' columns, by vocabulary."""
    return ", ".join(f"{v}_{m}" for v in vocabs for m in MEASURES)


def quality(df: DataFrame, vocabs: dict[str, str], bands: dict[str, tuple[Band, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """A row for each row: the counts, the measures by each vocabulary (name: path), the main script and the verdict ``kept``. Bands are in the order of the vocabularies."""
    bands = bands or BANDS
    schema = f"doc_id bigint, {BASE}, {columns(vocabs)}, script string, kept boolean"

    def run(batches):
        table = shared_table(tuple(vocabs.values()))
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                places = table.places([WORD.findall(t.encode("utf-8", "surrogatepass")) for t in texts])
                for d, t, lang, at in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), places):
                    n = len(at)
                    chars = len(t) - sum(map(t.count, SPACES))
                    lines = [x for x in t.split("\n") if x.strip(SPACES)]
                    repeat = 0
                    if n > 8:
                        h = grams(table.hash[at], 8)
                        order = np.argsort(h, kind="stable")
                        same = h[order][1:] == h[order][:-1]
                        if same.any():
                            twice = np.zeros(len(h), bool)
                            twice[order[1:][same]] = twice[order[:-1][same]] = True
                            repeat = int(covered(np.flatnonzero(twice), n, 8).sum())
                    failed = n < min_words or 100 * repeat > max_repeat_percent * n
                    own = [table.measures(k, at, chars) for k in range(len(vocabs))]
                    code = CODE_END.split((lang or "").strip().lower())[0]
                    of = script(t)
                    known = [code] if code in bands and code != "*" else [] if failed else candidates(t, of, bands)
                    kept = not failed and any(all(passes(*m, b) for m, b in zip(own, bands.get(k, BANDS["*"]))) for k in known)
                    rows.append((d, n, chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, *(x for m in own for x in m), of, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    names, kinds = zip(*((c.split()[0], types[c.split()[1]]) for c in schema.split(", ")))
    names = list(names)
    lang = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, schema)


def fit(good: DataFrame, vocabs: dict[str, str], by: str = "lang", rows: int = FIT_ROWS, text_col: str = "text") -> dict[str, tuple[Band, ...]]:
    """Bands of each language (column ``by``), or of each script (``by`` is "script"), from at most ``rows`` good rows that the base rules pass; with the wide bands."""
    key = F.lower(F.split(F.col(by).cast("string"), "[-_]")[0]) if by != "script" else F.lit(None).cast("string")
    some = stored(good.select(F.col(text_col).cast("string").alias("text"), key.alias("lang")).limit(rows).withColumn("id", F.xxhash64("text")), "fertility-rows")
    languages = some.groupBy("id").agg(F.min("lang").alias("lang")).withColumnRenamed("id", "doc_id")
    m = quality(some.dropDuplicates(["id"]), vocabs, id_col="id").where("NOT base_failed").join(languages, "doc_id")
    m = m.withColumn("key", F.col("script") if by == "script" else F.col("lang")).where("key <> ''")
    out: dict[str, list[Band]] = {}
    for v in vocabs:
        n, per, e = (F.col(f"{v}_{x}") for x in ("n_tokens", "chars_per_token", "entropy"))
        typical = m.groupBy("key").agg(F.percentile(per, 0.5).alias("per"), F.regr_slope(e, F.log2(n)).alias("growth"), F.regr_intercept(e, F.log2(n)).alias("start"))
        far = m.join(typical, "key").withColumn("f", (per - F.col("per")) * F.sqrt(n)).withColumn("e", e - F.col("start") - F.col("growth") * F.log2(n))
        edge = far.groupBy("key").agg(F.percentile("f", F.array(F.lit(BEYOND), F.lit(1 - BEYOND))).alias("f"), F.percentile("e", BEYOND).alias("e"), F.max(f"{v}_byte_share").alias("b"))
        for r in typical.join(edge, "key").where("growth IS NOT NULL").collect():  # a row a language or script
            out.setdefault(r.key, []).append(Band(r.per, r.start, r.growth, WIDER * r.f[0], WIDER * r.f[1], WIDER * r.e, 1.5 * r.b + 0.02))
    return {k: tuple(b) for k, b in sorted(out.items()) if len(b) == len(vocabs)} | {"*": BANDS["*"][: len(vocabs)]}
