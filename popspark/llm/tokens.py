"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table of token counts for the pre-tokens that are
frequent in a bounded sample (``sample_docs`` texts, ``table_size`` entries). A
pre-token that is not in it goes to the worker's own bounded cache, which the
tokenizer library fills. Counts never depend on the sample: it only decides
what is found quickly. Nothing is shuffled but the sample's own counts.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters that the ``regex`` module and byte-level pre-tokenizers class
#: alike; a text with others goes to the library whole.
_PLAIN = "[^\\x00-\\u0557\\u0d00-\\u208e\\u20a0-\\ua7cd\\uac00-\\ud7ff]"
#: The byte-level pre-tokenizer's pattern (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONGEST_KEPT = 48
_WORKERS: dict[str, "Counting"] = {}


class Counting:
    """Token counts of texts under one tokenizer, in one worker process."""

    def __init__(self, spec: str, table: dict[str, int], cache_size: int):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        pre = parts.get("pre_tokenizer") or {}
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not parts.get("normalizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.odd = regex.compile(_PLAIN).search
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table, self.cache, self.cache_size = table, dict(table), cache_size

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return self.by_pieces and not any(s in text for s in self.special) and not self.odd(text)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        split = {i: self.find(t) for i, t in enumerate(texts) if self.plain(t)}
        seen: set[str] = set()
        for p in split.values():
            seen.update(p)
        missing = list(seen.difference(self.cache))
        if len(self.cache) + len(missing) > self.cache_size + len(self.table):
            self.cache = dict(self.table)
            missing = list(seen.difference(self.cache))
        now = dict(zip(missing, self.whole(missing)))
        self.cache.update((k, v) for k, v in now.items() if len(k) <= _LONGEST_KEPT)
        get = self.cache.__getitem__
        if any(len(k) > _LONGEST_KEPT for k in now):
            get = lambda k, a=self.cache, b=now: a[k] if k in a else b[k]
        for i, p in split.items():
            out[i] = sum(map(get, p))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, n in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = n
        return out


def frequent_pretokens(docs: DataFrame, spec: str, id_col: str, text_col: str, sample_docs: int, table_size: int) -> dict[str, int]:
    """Token counts of the pre-tokens most frequent in a sample of at most ``sample_docs`` different (id, text) pairs."""
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    ids = [r[0] for r in docs.select(order.alias("o")).orderBy("o").limit(sample_docs).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, total = regex.compile(BYTE_LEVEL_PATTERN).findall, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(p for p in find(t or "") if len(p) <= _LONGEST_KEPT)
        if total:
            yield pa.RecordBatch.from_pydict({"p": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    # rows alike in id and text are one: repeated rows do not make the sample larger
    sample = docs.where(order.isin(ids)).groupBy(order.alias("o")).agg(F.first(text_col).alias(text_col)) if ids else None
    found = sample.select(text_col).mapInArrow(count, "p string, n long") if ids else None
    if found is None:
        return {}
    top = [r[0] for r in found.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(table_size).collect()]
    return dict(zip(top, Counting(spec, {}, 0).whole(top)))


def token_counts(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, sample_docs: int = 2000, table_size: int = 40_000, cache_size: int = 300_000, batch_bytes: int = 1 << 19) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``spec`` is the tokenizer's JSON. A null text counts as empty (0 bytes, 0
    tokens); null, repeated or tied ids give a row each; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    src = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_pretokens(src, spec, "k", "t", sample_docs, table_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec, table = shared.value
        key = hashlib.sha256(f"{spec}{len(table)}{next(iter(table), '')}{cache_size}".encode()).hexdigest()
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = Counting(spec, table, cache_size)
        of = _WORKERS[key]
        for b in batches:
            texts = b.column(1).to_pylist()
            texts = [t or "" for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            n, first, held = [], 0, 0
            for i, s in enumerate(sizes):
                held += s
                if held >= batch_bytes or i == len(sizes) - 1:
                    n += of.counts(texts[first : i + 1])
                    first, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", id_col)
