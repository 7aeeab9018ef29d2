"""One registered query for each training-data operator: opN_<name>."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, embed, html_text, iblt, mix, pieces, pii, quality, ranked, simhash, toxicity, urls, variants
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


MIX = {"target_entropy": 0.9, "max_repeats": 4.0}


@query("op1_temperature_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule that mixes the sources of all documents."""
    return mix.schedule(table(spark, sf_dir, "documents"), **MIX).drop("row_key")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_iblt_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return iblt.compare_with_next(table(spark, sf_dir, "documents"))


def joined_spans(spans: str):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op5_pii_disclosure")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal-data spans of every document."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.KINDS), F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


SIMHASH_SHINGLE = 3
SIMHASH_DISTANCE = 2


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_DISTANCE)


@query("op7_embedding_links")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


@query("op8_host_reputation", urls.oracle(URL_RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= toxicity.REJECT_AT).alias("toxic"))


@query("op10_bitplane_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id files of all documents, read back: place, length and checksum of each."""
    manifest = bitplane.write_ids(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        bitplane.new_folder(spark),
        end_id=2,
    )
    return bitplane.read_ids(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUALITY_METADATA = ["n_chars"]
QUALITY_GOOD = 0.7


@query("op11_quality_fm")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the ids is held out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *QUALITY_METADATA)

    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.fit(docs, labels, metadata=QUALITY_METADATA)
    return quality.score(docs, model, metadata=QUALITY_METADATA).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_GOOD).cast("int").alias("predicted"))


@query("op12_ranked_search", ranked.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near-word count of every frequent word of all documents."""
    return variants.group(table(spark, sf_dir, "documents"), typo_every=97)
