"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is split at spaces and line feeds, both of which the tokenizers at hand drop or
never join across (``safe`` checks the file's own settings), so a text's count is the sum
over its parts.  Parts of a batch are counted once each: the distinct ones that the task
has not met go to the library in calls of about ``call_bytes`` bytes, whatever the number
or the lengths of the texts.  Parts longer than a call travel alone.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of distinct parts in one call of the library.
CALL_BYTES = 1 << 20
#: Distinct parts whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Longest part, in characters, whose count is remembered.
SHORT = 64


def safe(config: dict) -> bool:
    """Whether counts add up over parts cut at spaces and line feeds: the file drops
    white space between pre-tokens, adds no prefix to a text and does not truncate."""
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    splits = [p for p in parts if p.get("type") == "Split"]
    prefixes = any(p.get("add_prefix_space") or p.get("prepend_scheme") in ("always", "first") for p in parts)
    pattern = (splits[0].get("pattern") or {}).get("Regex", "") if splits else ""
    drops = bool(splits) and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and r"[^\s" in pattern
    added = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] or "\n" in t["content"]
                for t in config.get("added_tokens") or [])
    return bool(drops) and not prefixes and not added


def packed(parts: Iterable[str], call_bytes: int) -> Iterator[list[str]]:
    """Lists of parts of about ``call_bytes`` bytes each."""
    pack, size = [], 0
    for p in parts:
        pack.append(p)
        size += len(p) + 16
        if size >= call_bytes:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


class Counter:
    """Counts tokens of texts with one tokenizer file; lives as long as its task."""

    def __init__(self, path: str, call_bytes: int = CALL_BYTES, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.call_bytes, self.remembered = call_bytes, remembered
        self.known: dict[str, int] = {"": 0}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                self.parts = safe(json.load(file))
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda xs: [len(e) for e in tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.parts = False
            self.encode = lambda xs: [len(ids) for ids in model.encode(xs, num_threads=1)]

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.parts:
            sizes = [[t or ""] for t in texts]
        else:
            sizes = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known = {"": 0}
        known = self.known
        fresh = list(set(itertools.chain.from_iterable(sizes)).difference(known))
        for pack in packed(fresh, self.call_bytes):
            known.update(zip(pack, self.encode(pack)))
        lengths = [sum(map(known.__getitem__, parts)) for parts in sizes]
        for p in fresh:
            if len(p) > SHORT:
                del known[p]
        return lengths


def blocks(texts: pa.Array, block_bytes: int = 4 * CALL_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array of about ``block_bytes`` bytes each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= block_bytes:
            yield texts.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield texts.slice(start)


def count_tokens(path: str, text: Column | str = "text") -> Column:
    """Tokens of ``text`` under the tokenizer file at ``path`` (.json or .model), without
    begin, end or added special tokens, truncation or padding."""

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for batch in batches:
            yield pa.array(itertools.chain.from_iterable(counter.counts(b.to_pylist()) for b in blocks(batch)), pa.int64())

    return lengths(F.col(text) if isinstance(text, str) else text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    counted = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        count_tokens(path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
