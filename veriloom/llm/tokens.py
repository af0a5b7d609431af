"""Token counts of whole texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_TOKENIZER = os.environ.get("VERILOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how public byte-level vocabularies cut a text before merging bytes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def load(path: str):
    """A function from a list of texts to a list of token id lists (one worker loads a file once).

    ``.tiktoken`` files hold ranks of byte sequences, ``.model`` files sentence pieces, all others a tokenizer in JSON.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranked = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [ranked.encode_ordinary(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``df`` with ``out``: tokens of column ``text``; 0 for null and empty texts.  The text column is dropped."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            counts: list[int] = []
            for a in range(0, len(texts), 256):
                counts += [len(ids) for ids in encode(texts[a : a + 256])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, schema)
