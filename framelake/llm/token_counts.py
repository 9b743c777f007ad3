"""Token counts through a digest cache.

The cache is a Parquet table (text_digest, tokenizer_digest, n_tokens). Documents are joined to it by the SHA-256 of
their content and of the tokenizer's file; only distinct contents that it lacks are encoded, and their counts are
appended. A text travels at most once, and only if the cache lacks something.

Defined results: null counts as the empty text (0 tokens); repeated rows are all returned; extra columns are ignored;
an empty table gives an empty result. A write that is cut off leaves no rows (Parquet job commit); a digest appended
twice by concurrent runs is read once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, materialise, scratch_dir, trimmed, whole

CACHE = "text_digest binary, tokenizer_digest string, n_tokens long"
#: Distinct pre-tokens whose counts a task remembers before it starts anew.
REMEMBERED = 150_000
#: Texts that are Python strings at a time.
SLICE = 256


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=2)  # a worker keeps its tokenizer over its tasks
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts as the library for this kind of file gives them."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core already
    spec = json.loads(Path(path).read_text())
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    if not plain or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        tok = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _by_pretoken(spec, [t["content"] for t in added])


def _by_pretoken(spec: dict, special: list[str]) -> Callable[[list[str]], list[int]]:
    """Byte-level BPE counts: pre-tokens are independent, so each distinct one is given to the library once."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    alone = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}))
    split = regex.compile(public_tokenizers.PATTERN).findall
    marks = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = marks.split(text) if marks else [text]
            n = len(parts) - 1
            for part in parts:
                words = split(part)
                if new := set(words).difference(known):
                    if len(known) > REMEMBERED:
                        known.clear()
                        new = set(words)
                    new = list(new)
                    known.update(zip(new, (len(x.ids) for x in alone.encode_batch_fast(new, add_special_tokens=False))))
                n += sum(map(known.__getitem__, words))
            out.append(n)
        return out

    return count


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    try:
        cache = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE)
    return cache.where(F.col("tokenizer_digest") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row; cache_path is read and appended to (a new cache where None)."""
    bounded_batches(docs)
    spark = docs.sparkSession
    cache_path, version = cache_path or f"{scratch_dir(spark)}/token_cache", tokenizer_digest(tokenizer)
    digest = F.unhex(F.sha2(whole(), 256)).alias("text_digest")
    keys = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), digest)
    cache = _read_cache(spark, cache_path, version)
    stored = bool(cache.head(1))
    texts = docs.select(whole().alias("text"), digest)
    if not stored or keys.select("text_digest").distinct().join(cache, "text_digest", "left_anti").head(1):
        misses = texts.groupBy("text_digest").agg(F.first("text").alias("text"))
        if stored:
            misses = misses.join(cache, "text_digest", "left_anti")

        @trimmed
        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text")
                n = [x for i in range(0, len(texts), SLICE) for x in counter(tokenizer)(texts.slice(i, SLICE).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("text_digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["text_digest", "tokenizer_digest", "n_tokens"])

        misses.select("text_digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
        cache = _read_cache(spark, cache_path, version)
    # a plain table, so that Spark may split the rows of a content that is copied very often
    found = materialise(keys.select("text_digest").distinct().join(cache, "text_digest"), "counts")
    return keys.join(found, "text_digest").select("doc_id", "n_bytes", "n_tokens")
