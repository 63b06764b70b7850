"""SentencePiece encoding with byte offsets into the original text, and decoding.

The text is normalised by longest prefixes through the compiled character map of the model, which records
for each normalised byte the original byte it comes from. The normalised text is encoded in units that no piece
can cross, so each distinct unit is encoded once; pieces are laid over the normalised bytes and projected
back to spans of original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grantstar.llm.tasks import map_slices

SPACE = "▁"
#: Distinct units of text whose ids a task remembers.
REMEMBERED_UNITS = 200_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        self._of: dict[int, bytes] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``text`` has at ``start``."""
        units, found, node = self.units, None, 0
        node ^= _offset(units[0])
        for at in range(start, len(text)):
            node ^= text[at]
            if node >= len(units) or units[node] & 0x800000FF != text[at]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, at + 1 - start
        return found and (self._replacement(found[0]), found[1])

    def _replacement(self, at: int) -> bytes:
        if at not in self._of:
            self._of[at] = self.replacements[at : self.replacements.index(0, at)]
        return self._of[at]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 1 << 9) >> 6)


@dataclass
class Normaliser:
    """Normalised bytes, and for each of them (and the end) the original byte offset."""

    characters: CharacterMap
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.characters and not self.trim_spaces:
            return self._plain(text)
        return self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Nothing to map: only spaces grow, so the alignment follows from where they are."""
        space = SPACE.encode() if self.escape_spaces else b" "
        raw = np.frombuffer(text, np.uint8)
        to = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
        before = len(space) if self.dummy_prefix else 0
        to = np.concatenate([np.zeros(before, np.int64), to, [len(raw)]])
        return space[:before] + text.replace(b" ", space), to

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE.encode() if self.escape_spaces else b" "
        out, to, last_space = bytearray(), [], self.trim_spaces
        at = 0
        for piece, length in self._prefixes(text):
            if not out and self.dummy_prefix and not (last_space and not piece.strip(b" ")):
                out += space
                to += [at] * len(space)
            if last_space:
                piece = piece.lstrip(b" ")
            if piece:
                grown = piece.replace(b" ", space)
                out += grown
                to += [at] * len(grown)
                last_space = self.trim_spaces and piece.endswith(b" ")
            at += length
        end = at
        while self.trim_spaces and out.endswith(space):
            end = to[len(out) - len(space)]
            del out[-len(space) :], to[-len(space) :]
        return bytes(out), np.array([*to, end], np.int64)

    def _prefixes(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(text):
            found = self.characters.longest(text, at) if self.characters else None
            if not found:
                first = text[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = text[at : at + n], n
            yield found
            at += found[1]


class Codec:
    """Encoder and decoder of one model file, given as bytes. BPE models with byte fallback only."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        ordinary = [p.piece for p in spec.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)]
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback")
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined pieces and white space as suffix are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in ordinary):
            raise ValueError("the model has pieces that run over a space")
        self.normalise = Normaliser(
            CharacterMap(norm.precompiled_charsmap),
            norm.add_dummy_prefix,
            norm.remove_extra_whitespaces,
            norm.escape_whitespaces,
        )
        self.lengths = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64
        )
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces = b"", False, False
        self.units = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        # A line end that is in no longer piece also parts units.
        cut = "" if any("\n" in p and len(p) > 1 for p in ordinary) else "\n"
        self.split = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+|[{cut or SPACE}]").findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text its ids, with begin and end, and an array (ids, 2) of original byte spans.

        Begin and end have the empty spans at the two ends of the text.
        """
        normal = [self.normalise(t.encode("utf-8", "replace")) for t in texts]
        parts = [self.split(n.decode("utf-8", "replace")) for n, _ in normal]
        new = list({u for p in parts for u in p if u not in self.known})
        if len(self.known) + len(new) > REMEMBERED_UNITS:
            again = {u for p in parts for u in p if u in self.known}
            self.known = {u: self.known[u] for u in again}
        self.known.update(zip(new, self.units.encode(new, num_threads=1)))
        known = self.known
        for (_, to), units in zip(normal, parts):
            ids = [self.begin]
            for unit in units:
                ids += known[unit]
            ends = np.cumsum(self.lengths[ids[1:]]) if len(ids) > 1 else np.zeros(0, np.int64)
            spans = np.zeros((len(ids) + 1, 2), np.int64)
            spans[1:-1, 1] = to[ends]
            spans[2:-1, 0] = spans[1:-2, 1]
            spans[-1] = to[-1]
            ids.append(self.end)
            yield ids, spans

    def decode(self, ids: Iterable[int]) -> str:
        return self.whole.decode(list(ids))


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids, starts, ends (original byte offsets, end exclusive).

    A null text is encoded like an empty one: begin and end ids only. Rows are handled one by one, so repeated
    rows and ids, and an empty table, need no rule. Only doc_id and text are looked at. The model file
    is read on the driver and travels with the tasks.
    """
    model = _model(model_path)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
            T.StructField("starts", T.ArrayType(T.LongType(), False), False),
            T.StructField("ends", T.ArrayType(T.LongType(), False), False),
        ]
    )

    def make():
        codec = Codec(model)

        def work(columns):
            coded = list(codec.encode([t or "" for t in columns[1]]))
            return [columns[0], [i for i, _ in coded], [s[:, 0] for _, s in coded], [s[:, 1] for _, s in coded]]

        return work

    return map_slices(docs.select("doc_id", "text"), make, schema)


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of ``coded`` (doc_id, ids). Null ids give an empty text."""
    model = _model(model_path)
    schema = T.StructType(
        [T.StructField("doc_id", coded.schema["doc_id"].dataType), T.StructField("text", T.StringType(), False)]
    )

    def make():
        codec = Codec(model)
        return lambda columns: [columns[0], [codec.decode(i or []) for i in columns[1]]]

    return map_slices(coded.select("doc_id", "ids"), make, schema)


def codec_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, and ids
    if asked for.

    What ``encode_documents`` and ``decode_documents`` give, digested inside the task: ids as little-endian
    unsigned 32-bit integers, the decoded text in UTF-8, spans as pairs of little-endian 64-bit integers.
    """
    model = _model(model_path)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False),
            T.StructField("spans_sha256", T.StringType(), False),
        ]
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False), False)

    def make():
        codec = Codec(model)

        def digest(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        def work(columns):
            out = [columns[0], *([] for _ in schema.fields[1:])]
            for ids, spans in codec.encode([t or "" for t in columns[1]]):
                raw = np.array(ids, "<u4")
                text = codec.decode(ids)
                row = len(ids), digest(raw.tobytes()), digest(text.encode()), digest(spans.astype("<i8").tobytes())
                for column, value in zip(out[1:], (*row, raw)):
                    column.append(value)
            return out

        return work

    return map_slices(docs.select("doc_id", "text"), make, schema)
