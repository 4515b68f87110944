"""Exact token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token here is a stretch of text that starts at a space which follows a non-space and precedes one. No token of a
byte-level tokenizer reaches over such a place, so a text has as many tokens as its pre-tokens have together, and a
pre-token's count does not depend on where it stands.

1. Frequent pre-tokens of the corpus: each task reports those that make up a fixed share of its own; at most ``HOT`` of
   them are kept, their pieces counted once and broadcast (the size is bounded by ``HOT``, whatever the corpus).
2. Each document is a table of pre-token frequencies, joined to that table. The pre-tokens of a block of documents that
   are not in it are counted once for the block, so that no row of a document is shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pre-tokens that are broadcast.
HOT = 200_000
#: A task reports a pre-token that makes up one in so many of its own, and keeps so many counters or counts at most.
SHARE, COUNTERS = 1_000_000, 300_000
#: Characters of a block of documents whose pre-tokens are counted together; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
OVER = 1024
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LOADED: dict = {}


def pre_tokens(text: str) -> Counter:
    """Pre-tokens of a text and how often each occurs."""
    first, *rest = text.split(" ")
    found = Counter(rest)
    if not first or any(not x or x[0].isspace() or x[-1].isspace() for x in found) or first[-1].isspace():
        return Counter(_CUT.split(text)) if text else Counter()
    out = Counter({" " + x: n for x, n in found.items()})
    out[first] += 1
    return out


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _pieces(path: str, texts: list[str]) -> list[int]:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return [len(x.ids) for x in _LOADED[path].encode_batch(texts, add_special_tokens=False)]


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    seen = 0
    for batch in batches:
        for text in batch["text"]:
            found = pre_tokens(text)
            seen += found.total()
            counts.update(found)
            if len(counts) > COUNTERS:
                counts = Counter({k: n for k, n in counts.items() if n > 1 + seen // COUNTERS})
    kept = [(k, n) for k, n in counts.items() if n > 1 and n * SHARE >= seen]
    yield pd.DataFrame(kept, columns=["pre_token", "n"])


def frequent(docs: DataFrame, limit: int = HOT) -> list[str]:
    """At most ``limit`` of the most frequent pre-tokens. Which ones does not bear on results, only on what is shuffled."""
    found = docs.mapInPandas(_report, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return [r[0] for r in found.orderBy(F.desc("n"), "pre_token").limit(limit).select("pre_token").collect()]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each document.

    ``tokenizer``: path of a tokenizer file with byte-level pre-tokenization, there on each executor.
    Null texts count as empty: 0 bytes, 0 tokens. One row for each row, repeated ones included. An empty table gives an
    empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hot = frequent(texts.select("text"))
    known = spark.sparkContext.broadcast(dict(zip(hot, _pieces(tokenizer, hot))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, rare = known.value, {}
        for batch in batches:
            sums = []
            for block in blocks(batch["text"]):
                tables = [pre_tokens(text) for text in block]
                if len(rare) > COUNTERS:
                    rare.clear()
                new = list({k for found in tables for k in found if k not in table and k not in rare})
                rare.update(zip(new, _pieces(tokenizer, new)))
                sums += [sum(n * (table.get(k) or rare[k]) for k, n in found.items()) for found in tables]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": sums})

    kind = docs.schema[id_col].dataType.simpleString()
    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sized.mapInPandas(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
