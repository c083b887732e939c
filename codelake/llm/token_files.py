"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of shards in ascending document order.  Shard n has three flat little-endian
files: ``n.tokens`` (ids, 2 bytes each if the vocabulary allows, else 4), ``n.offsets`` (unsigned
64-bit: the position of each document's first id in the shard, and the shard's end) and ``n.docs``
(signed 64-bit document ids).  A shard's base, the number of ids before it, is the prefix sum of the
shards' lengths, so global positions need no second pass.  Readers map the files into memory.

Tasks write to a name of their own and rename it, so a task that runs again replaces its shard by
the same bytes.  Only one row per shard comes to the driver.

For byte-level BPE tokenizers, texts are split at single spaces between other characters (the
pre-tokenizer always splits there), pieces by the pre-tokenizer's pattern, and each distinct part is
encoded once per worker by the tokenizer's model; the tables of parts are bounded.  Other
tokenizers, and texts that hold an added token, are encoded whole.

Edge cases: null and empty texts have the end id alone; null document ids come first and are read
back as null; equal ids stay next to each other; an empty table gives an empty data set; further
columns play no part.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem_of, fresh_path

#: White space of any kind; next to one of these a space isn't a safe place to cut.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
_ASCII_SPACES = "".join(c for c in _SPACES if c.isascii())
#: What libraries don't agree on.
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85")
_SAFE_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
_NULL_ID = np.iinfo(np.int64).min


class _Table(dict):
    """Ids as bytes, made when first asked for; of a full table, what is asked for again goes on."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class _Words(_Table):
    """Words behind a space; those of ASCII letters go to the model as they are."""

    def __init__(self, make, most: int, model, kind: str, space: str):
        super().__init__(make, most)
        self.tokenize, self.kind, self.space = model.tokenize, kind, space

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and len(self) < self.most and word not in self.before:
            self[word] = found = array(self.kind, [t.id for t in self.tokenize(self.space + word)]).tobytes()
            return found
        return super().__missing__(word)


class PieceEncoder:
    """Ids of a text as little-endian bytes."""

    def __init__(self, tokenizer_file: str, dtype: str, most_pieces: int = 400_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer_file), {"<u2": "H", "<u4": "I"}[dtype]
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        # a byte-level tokenizer splits by one pattern and maps bytes to letters; its model then merges each part alone
        self.by_part = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.split, self.model = regex.compile(public_tokenizers.PATTERN).findall, self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come here once: the tables below remember them
        self.parts = _Table(self._part, most_pieces)
        self.after_space = _Words(self._word, most_pieces, self.model, self.kind, self.letters[32])

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            mapped = part.replace(" ", self.letters[32])  # other printable ASCII stands for itself
        else:
            mapped = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word behind a space; Latin letters, with or without marks that end a sentence, need no pattern."""
        stem = word.rstrip(".,;:!?")
        if not stem.isalpha() or not stem.isascii() and max(stem) >= "\u0250":
            return self._piece(" " + word)
        return self._part(" " + word) if len(stem) == len(word) else self.after_space[stem] + self.parts[word[len(stem) :]]

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(piece)))

    def encode(self, text: str) -> bytes:
        if not self.by_part or any(t in text for t in self.added):
            return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        present = [c for c in (_ASCII_SPACES if text.isascii() else _SPACES) if c in text]
        safe = _ODD.isdisjoint(present) and "  " not in text and text[:1] != " " != text[-1:] and not any(f" {c}" in text or f"{c} " in text for c in present)
        first, *rest = text.split(" ") if safe else _SAFE_SPACE.split(text)
        return self._piece(first) + b"".join(map(self.after_space.__getitem__, rest))


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, dtype: str) -> PieceEncoder:
    """One for all tasks that a worker runs, so that its tables go on."""
    return PieceEncoder(tokenizer_file, dtype)


def _dtype(tokenizer_file: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_dataset(
    docs: DataFrame, uri: str, tokenizer_file: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", bytes_per_shard: int = 12_000_000
) -> list[tuple[int, int, int]]:
    """Encode the documents and write the shards; (shard, documents, tokens) of each, ascending."""
    dtype = _dtype(tokenizer_file, end_id)
    end = np.array([end_id], dtype=dtype).tobytes()
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // bytes_per_shard))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, (filesystem, root), encoder = TaskContext.get().partitionId(), filesystem_of(uri), _encoder(tokenizer_file, dtype)
        filesystem.create_dir(root, recursive=True)
        own, n_docs, at = f"{root}/.{shard:07d}-{uuid.uuid4().hex}", 0, 0
        names = ("tokens", "offsets", "docs")
        out = {n: filesystem.open_output_stream(f"{own}.{n}") for n in names}
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                ids = [encoder.encode(t) + end for t in part["text"]]
                starts = at + np.cumsum([0, *(len(b) // len(end) for b in ids)])
                out["tokens"].write(b"".join(ids))
                out["offsets"].write(starts[:-1].astype("<u8").tobytes())
                out["docs"].write(part["doc_id"].to_numpy().astype("<i8").tobytes())
                n_docs, at = n_docs + len(part), int(starts[-1])
        out["offsets"].write(np.array([at], dtype="<u8").tobytes())
        for n in names:
            out[n].close()
            filesystem.move(f"{own}.{n}", f"{root}/{shard:07d}.{n}")
        yield pd.DataFrame({"shard": [shard], "n_docs": [n_docs], "n_tokens": [at]})

    ordered = narrow.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = ordered.select("doc_id", "text").mapInPandas(run, "shard int, n_docs long, n_tokens long").collect()
    return sorted((r.shard, r.n_docs, r.n_tokens) for r in rows)


def read_dataset(spark, uri: str, shards: list[tuple[int, int, int]], *, width: int) -> DataFrame:
    """Per document: doc_id, start (over all shards), n_tokens and the crc32 of its ids as 32-bit integers."""
    base = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).tolist()
    listed = [(s, b) for (s, n, _), b in zip(shards, base, strict=False) if n]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def mapped(filesystem, path: str, dtype: str) -> np.ndarray:
        if filesystem.type_name == "local":
            return np.memmap(path, dtype=dtype, mode="r")
        with filesystem.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype=dtype)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = filesystem_of(uri)
        for frame in frames:
            for shard, start in zip(frame["shard"], frame["base"], strict=True):
                tokens, offsets, ids = (mapped(filesystem, f"{root}/{shard:07d}.{n}", d) for n, d in (("tokens", f"<u{width}"), ("offsets", "<u8"), ("docs", "<i8")))
                offsets = offsets.astype(np.int64)
                sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = pd.array(ids, dtype="Int64")
                found[np.asarray(ids) == _NULL_ID] = pd.NA
                yield pd.DataFrame({"doc_id": found, "start": start + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": sums})

    return spark.createDataFrame(listed, "shard int, base long").repartition(len(listed)).mapInPandas(run, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, *, end_id: int = 2, uri: str | None = None, **columns) -> DataFrame:
    """Encode, write and read back."""
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "token-files")
    width = int(_dtype(tokenizer_file, end_id)[-1])
    shards = write_dataset(docs, uri, tokenizer_file, end_id=end_id, **columns)
    return read_dataset(spark, uri, shards, width=width)
