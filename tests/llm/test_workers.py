"""What Python workers do: how many a task needs, and the ways they take for speed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from stratalog.llm import language, queries, tokens


def test_language_takes_one_worker_a_task(spark, sf, monkeypatch):
    """Weights and verdicts take no worker beside the one that takes the evidence; texts that are carried aren't sent twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, plans = language.train(docs, queries.LANGUAGES), []

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    stored = language.stored
    monkeypatch.setattr(language, "stored", lambda df, name: plans.append(plan(df)) or stored(df, name))
    columns = {"id_col": "doc_id", "text_col": "text", "declared_col": "lang", "host_col": "source"}
    found = language.identify(docs, model, queries.LANGUAGES, **columns, carry=docs.columns)
    assert [p.count("MapInArrow") for p in (*plans, plan(found))] == [1, 1]
    monkeypatch.undo()
    other = language.identify(docs, model, queries.LANGUAGES, **columns)
    show = ["id", "language", F.round("probability", 12), "kept"]
    assert sorted(found.select(*show).collect(), key=str) == sorted(other.select(*show).collect(), key=str)
    assert found.select("carried.*").exceptAll(docs).count() == 0 and found.count() == docs.count()


def test_rare_words_take_ranks():
    """Words of Latin-1 letters are encoded by the rank form, with the library's ids, and rare words with a mark are kept once."""
    bpe = tokens.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.ranks is not None
    r, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿªµº"
    parts = [x for t in bpe.whole.get_vocab() if (x := t.removesuffix("</w>")).isascii() and x.isalpha()]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(5000)] + ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(20000)]
    words += [w.upper() for w in words[::7] if tokens.LATIN.fullmatch(w.upper())] + ["a" * 5000, "é" * 5000]
    assert all(bpe._letters(w) == bpe._piece(w.lower()) for w in words)
    for text in ("Wörter, words. ÀÉÿ µ; a", "thenthha, thenthha.", " x!  y\n\nz?"):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert "thenthha." in bpe.words and "thenthha" not in bpe.words
    assert tokens.word_ranks(public_tokenizers.path("byte_bpe_50k.json"), None) is None


def test_words_are_encoded_together():
    """Texts at once have the library's ids; the rank form takes several plain words a call, and no long ones, for which its time is quadratic."""
    bpe = tokens.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    r, calls, ranks = random.Random(5), [], bpe.ranks
    bpe.ranks = lambda b: calls.append(b) or ranks(b)
    made = ["".join(r.choice("abcdefgßéñüÀÖØªµº") for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", ",", ";", ")", "?!", "%%%"]) for _ in range(4000)]
    odd = ["", " ", "\n\n", "a", ".", "..", "x.", ".x", "'s", "it's", "a\tb", "a\r\nb", "a b", "é", "İstanbul", "日本語 語", "😀 a", "ſ", "K", "ÿ Ÿ", "<|endoftext|> a", "×÷", "a×b.", "n0n", "a" * 64 + ".", "é" * 65, "Word Word. word, WORD)"]
    texts = [None, *odd, *(" ".join(made[i : i + 40]) for i in range(0, len(made), 40)), "a" * 30_000 + " é" * 600, None]
    want = [bpe.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = pa.array(texts, pa.string())
    calls.clear()
    assert [x.tolist() for x in bpe.encode_all(whole)] == want
    assert len(calls) < 3000 and max(map(len, calls)) <= tokens.ROW * (2 * tokens.RANK_CHARS)
    assert [x.tolist() for x in bpe.encode_all(whole.slice(5, 40))] == want[5:45]
    assert bpe.encode_all(whole.slice(0, 0)) == [] and [len(x) for x in bpe.encode_all(whole.slice(0, 1))] == [0]
    bpe.together = False
    assert [x.tolist() for x in bpe.encode_all(whole)] == want
