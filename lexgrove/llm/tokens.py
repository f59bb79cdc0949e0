"""Encoding whole texts with a public byte-level BPE vocabulary.

The vocabulary's rank file gives the same ids as its ``tokenizers`` file, several times faster; a text
that holds the special token's own string is encoded by ``tokenizers`` itself, which knows it as one id.
Both files' places are parameters; by default the installed ``public_tokenizers`` package names them.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The id that ends every document.
END = 0
SPECIAL = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=4)
def encoder(ranks_file: str | None = None, tokenizer_file: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) of the whole text, without the end id."""
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if ranks_file is None or tokenizer_file is None:
        import public_tokenizers

        ranks_file = ranks_file or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
        tokenizer_file = tokenizer_file or public_tokenizers.path(f"{VOCABULARY}.json")
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = None

    def encode(text: str) -> np.ndarray:
        nonlocal slow
        if SPECIAL in text:
            if slow is None:
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(tokenizer_file)
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


def lengths(docs: DataFrame, ranks_file: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens (end id included) for each row of docs(doc_id, text); null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file, tokenizer_file)
        for b in batches:
            n = [1 + len(encode(t)) if t else 1 for t in (x.as_py() for x in b.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long")
