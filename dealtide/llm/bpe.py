"""BPE encoding and decoding by forced boundaries.

Byte pairs that occur inside no token of the vocabulary can never be merged, so they mark certain cuts. Of these pairs
the encoder uses the ones of a visible ASCII character and a following space, where the pre-tokenizer also always
ends a piece (its pieces hold white space only in front): there a text falls into fragments that encode independently.
A fragment met before is looked up; only new ones are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .registry import query

SPACES = b" \t\n\v\f\r"
#: Bytes of fragments and ids a worker keeps, besides those of the text at hand; beyond it starts anew. An entry costs ENTRY more.
KEPT_BYTES, ENTRY = 48 << 20, 200


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """A 256 x 256 table of the byte pairs that occur inside some token."""
    table = np.zeros((256, 256), bool)
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])[:-1]
    keep = np.ones(len(joined) - 1, bool)
    keep[ends - 1] = False
    table[joined[:-1][keep], joined[1:][keep]] = True
    return table


class Codec:
    """One vocabulary, loaded once per Python worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        plain = byte_of_char()
        vocabulary = {n: bytes(plain[c] for c in token) for token, n in spec["model"]["vocab"].items() if n not in self.added}
        self.bytes_of = [b""] * (max(vocabulary | self.added) + 1)
        for n, token in (vocabulary | self.added).items():
            self.bytes_of[n] = token
        inside = pairs_inside([t for t in self.bytes_of if t])
        visible = bytes(b for b in range(33, 127) if not inside[b, list(SPACES)].any())
        gap, stop = b"[" + re.escape(SPACES) + b"]", b"[^" + re.escape(visible + SPACES) + b"]"
        word = b"[^" + re.escape(SPACES) + b"]*"
        # A fragment: white space, a word, and any further words that follow no certain cut.
        self.fragment = re.compile(gap + b"*(?:" + word + stop + gap + b"+)*" + word)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.decimal = [b"%d," % n for n in range(len(self.bytes_of))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, find = self.known, self.fragment.findall
        found = []
        for text in texts:
            if self.held > KEPT_BYTES:
                known.clear()
                self.held = 0
            parts = find(text.encode())
            new = list({p for p in parts if p not in known})
            for start in range(0, len(new), 4096):
                some = new[start : start + 4096]
                for part, made in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                    known[part] = np.array(made.ids, np.int32).tobytes()
                    self.held += len(part) + len(known[part]) + ENTRY
            found.append(np.frombuffer(b"".join([known[p] for p in parts]), np.int32))
        return found

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        table = self.decimal
        return b"".join([table[n] for n in ids.tolist()])[:-1]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[n] for n in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) for every row: the ids the vocabulary at ``path`` gives the whole text.

    The path must exist on every node. Null and empty texts have no ids; strings of added tokens become those tokens.
    Ids, repeated rows and their number are kept as they are; other columns are not returned. No shuffle.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids = made.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the text of the ids; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                lists = part.column(1)
                values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                texts = [made.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    source = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text): number and digest of the ids of each text, and the
    digest of what they decode to.

    One pass: a task has one Python worker, and neither ids nor decoded texts leave it. Null and empty texts have no ids and decode to
    the empty text. Repeated rows and null ids stay; other columns are left out, whatever their names.
    """
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            counts, ids_digests, digests = [], [], []
            for text in batch.column(1):
                (ids,) = made.encode([text.as_py() or ""])
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(made.listed(ids)).hexdigest())
                digests.append(hashlib.sha256(made.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op6_bpe_round_trip")
def op6(spark, sf_dir):
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
