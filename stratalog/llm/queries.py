"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fertility, imatch, language, lines, ngram_join, packing, pii, substrings, token_files, tokens
from .arrow import work_dir


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The languages of the labelled rows.
LANGUAGES = ["de", "en", "es", "fr"]
#: The vocabularies of the quality rules.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "multi": "byte_bpe_multi_50k.tiktoken"}
#: The key of the pseudonyms; a deployment passes its own to pii.pseudonymise.
KEY = b"stratalog example key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    ids = tokens.encode_documents(documents(spark, sf_dir), path)
    return tokens.decode_documents(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir), KEY)
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_pseudonyms"), F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "token-files")
    manifest = token_files.write_token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), out)
    return token_files.read_token_files(spark, out, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), {v: vocabulary(f) for v, f in VOCABULARIES.items()})


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language.train(docs, LANGUAGES)
    of_docs = language.identify(docs, model, LANGUAGES, id_col="doc_id", text_col="text", declared_col="lang", host_col="source")
    of_pages = language.identify(pages, model, LANGUAGES, id_col="page_id", text_col="html", url_col="url", html=True)
    none = F.lit(None).cast("long")
    shown = ["language", F.round("probability", 6).alias("probability"), "kept"]
    return of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), *shown).union(of_pages.select(none, "id", *shown))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_ngram_jaccard_join,
        op3_pii_pseudonyms,
        op4_line_dedup,
        op5_substring_dedup,
        op6_token_files,
        op7_tokeniser_fertility,
        op8_lexical_packing,
        op9_imatch_fingerprints,
        op10_language_id,
    )
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id""",
    "op4_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> owner) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR doc_id = owner), '')) AS kept_sha256 FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op5_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM v JOIN (SELECT v, min(doc_id) AS low FROM v GROUP BY v) USING (v) WHERE doc_id > low),
o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w
LEFT JOIN (SELECT o.doc_id, count(hit.pos) AS n, string_agg(word, ' ' ORDER BY o.pos) FILTER (WHERE hit.pos IS NULL) AS t FROM o LEFT JOIN hit ON hit.doc_id = o.doc_id AND hit.pos = o.pos GROUP BY o.doc_id) k ON k.doc_id = w.doc_id""",
}
