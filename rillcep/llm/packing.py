"""Sequence packing by power-of-two decomposition (Pouransari et al., Dataset Decomposition, NeurIPS 2024).

A document of n tokens is cut into n // context full pieces and the binary digits of the rest, largest first. Every
piece is a sequence of its own in the bucket of its length, so none crosses documents and none needs padding.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import sub_batches, table

#: Chunks whose ids a worker remembers, about.
REMEMBERED = 1_500_000


def lengths(tokens: int, context: int) -> list[int]:
    """Piece lengths: context (a power of two) as often as it fits, then the binary digits of the rest."""
    full, rest = divmod(tokens, context)
    return [context] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Numbers(dict):
    """Chunks numbered as they come."""

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        return n


class Encoder:
    """Token ids of texts as little-endian 32-bit words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks; each distinct
    chunk is encoded once. Plain chunks (Latin letters, perhaps marks behind) are encoded many at a time by the same
    model without its slow normalizer and pre-tokenizer, whose work on such chunks is known: composed, lower-cased,
    and one or two pre-tokens, the last id of which, and no other, has a word end."""

    PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        model |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytewise]}}
        self.plain = Tokenizer.from_str(json.dumps(model))
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # no chunk comes twice
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(1 << 16, dtype="<u4")  # all chunks' ids; chunk i has sizes[i] from starts[i]
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.used = self.learned = 0

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _keep(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, dtype="<u4")])
        self.ids[self.used : need] = ids
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.used = need

    def _learn(self, fresh: list[bytes]) -> None:
        first, self.learned = self.learned, self.learned + len(fresh)
        if self.learned > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(self.learned, dtype=np.int64)]) for x in (self.starts, self.sizes))
        text = [c.decode() for c in fresh]
        found = [self.PLAIN.fullmatch(t) for t in text]
        counts = np.array([0 if m is None else 1 + (m.end() > m.start(1)) for m in found], dtype=np.int64)
        plain, other = np.flatnonzero(counts), np.flatnonzero(counts == 0)
        for lo in range(0, len(plain), 500):
            part = plain[lo : lo + 500]
            joined = " ".join([text[i] if counts[i] == 1 else f"{text[i][: found[i].start(1)]} {found[i][1]}" for i in part])
            joined = unicodedata.normalize("NFC", joined.lower())
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(counts[part])
            if len(ends) != last[-1]:
                other = np.append(other, part)
                continue
            self._keep(first + part, ids, np.diff(ends[last - 1], prepend=0))
        if len(other):
            rows = self._encode([text[i] for i in other])
            self._keep(first + other, np.array([i for r in rows for i in r], dtype="<u4"), np.array([len(r) for r in rows]))

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if self.learned > REMEMBERED:
            self._forget()
        chunks = [t.split() if t else [] for t in texts]
        number = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(chunks)), dtype=np.int64)
        if len(self.numbers) > self.learned:
            self._learn(list(itertools.islice(self.numbers, self.learned, None)))
        sizes = self.sizes[number]
        stops = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[number] - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]
        cuts = np.concatenate([[0], stops])[np.cumsum([len(c) for c in chunks])]
        return np.split(ids, cuts[:-1]) if len(chunks) else []


_ENCODERS: dict[str, Encoder] = {}


def _packer(path: str, context: int, end: np.uint32, with_ids: bool):
    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in sub_batches(texts, 2 << 20):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids")}
                for doc, ids in zip(docs[lo:hi], encoder(texts[lo:hi])):
                    ids = np.append(ids, end)
                    n, at = len(ids), 0
                    for size in lengths(n, context):
                        piece = ids[at : at + size].tobytes()
                        for k, v in zip(out, (doc, at, size, zlib.crc32(piece), n, sequence, piece)):
                            out[k].append(v)
                        at, sequence = at + size, sequence + 1
                cols = [pa.array(out[k], pa.int64()) for k in list(out)[:-1]] + [pa.array([0] * len(out["start"]), pa.int64())]
                names = [*list(out)[:-1], "offset"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in out["ids"]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, path: str | None = None, context: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    length is the bucket: always a power of two up to context. A null or empty text is the end id alone. Repeated rows
    are packed again. An empty table gives an empty result; other columns are ignored. No shuffle: sequences are
    numbered inside each input partition, whose number is the upper part of sequence_id."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return d.mapInArrow(_packer(path or tokenizer_path(), context, np.uint32(end_id), with_ids), schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes pieces with their ids in one folder per length; a batch drawn from a folder has sequences of one length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), context=2048, end_id=1, with_ids=False)
