"""The queries of this folder's operators, over whole tables. Their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import neighbours
from .exact import groups
from .fingerprint import fingerprints
from .langid import identify
from .licenses import scan
from .lm import score
from .merkle import verification
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLE_SQL
from .runtime import table
from .spm import DIGESTS, encode, read_model
from .spelling import spelling
from .suffix import removal
from .warc import round_trip


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def tokenizer(path: str | None = None) -> bytes:
    """A sentencepiece BPE model; the public one of 32,000 pieces if no path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return read_model(path)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer(), DIGESTS)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks", "runs")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("uid")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_minhash": op2_minhash,
    "op3_lm_scores": op3_lm_scores,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_neighbours": op5_neighbours,
    "op6_mix": op6_mix,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_langid": op9_langid,
    "op10_licenses": op10_licenses,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer"]
