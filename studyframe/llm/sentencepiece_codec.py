"""SentencePiece models on the tokenizers library: the model file is parsed, its normaliser and pieces are rebuilt.

The driver reads the model once and sends its bytes; a Python worker builds the tokenizer once and encodes Arrow
batches with the library's threads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm.textkernel import resting

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of the texts that are encoded in one call.
CALL_CHARS = 1 << 18

# Numbers of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """pieces (text, score, kind) by id, and the settings that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((bytes(piece.get(1, b"")).decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_marks = bool(trainer.get(24, 0))
        self.charsmap = bytes(normal.get(2, b""))
        self.dummy_prefix = bool(normal.get(3, 1))
        self.strip_spaces = bool(normal.get(4, 1))
        self.escape_spaces = bool(normal.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or self.suffix_marks or not self.escape_spaces:
            raise ValueError("only unigram and BPE models with leading, escaped white space are supported")

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model. SentencePiece joins the pair whose whole has the best score, so each way to cut a
    piece into two pieces is a merge, in the order of the pieces' scores."""
    score = {p: (s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, (s, i) in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-s, i, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model):
    """The tokenizer: normaliser (character map, white space, marker), cuts before words where no piece crosses them, pieces."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown(), byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=model.pieces[model.unknown()][0], fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=False)
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    made.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+$"), "isolated")
    parts = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    made.decoder = decoders.Sequence(parts)
    return made


@lru_cache(maxsize=2)
def _built(data: bytes):
    return build(Model(data))


def read_model(path: str) -> bytes:
    """The bytes of a model file, local or in a store that pyarrow opens."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name) as file:
        return file.read()


def _calls(texts: list[str] | pa.Array) -> Iterator[list[str]]:
    call, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else t.as_py()
        if call and size + len(t) > CALL_CHARS:
            yield call
            call, size = [], 0
        call.append(t)
        size += len(t)
    if call:
        yield call


def encode_texts(data: bytes, texts: list[str]) -> list[list[int]]:
    """Ids of each text, some texts at a time by the threads of the library."""
    made, out = _built(data), []
    for call in _calls(texts):
        out += [e.ids for e in made.encode_batch_fast(call, add_special_tokens=False)]
    return out


@lru_cache(maxsize=2)
def _piece_bytes(data: bytes) -> tuple[pa.Array, np.ndarray, bool]:
    """What each id stands for in a text, which ids decode by joining that, and whether a leading marker is dropped."""
    model = Model(data)
    by_value = {f"<0x{b:02X}>": bytes([b]) for b in range(256)} if model.byte_fallback else {}
    joins = [kind in (NORMAL, USER_DEFINED) and not (len(p) == 6 and p.startswith("<0x")) or kind == BYTE and p in by_value for p, _, kind in model.pieces]
    texts = [by_value.get(p) if kind == BYTE and p in by_value else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
    return pa.array(texts, pa.binary()), np.array(joins, dtype=bool), model.dummy_prefix


def decode_ids(data: bytes, ids: pa.ListArray) -> pa.Array:
    """The texts that lists of ids of the model decode to: their pieces joined. Lists with other ids, and bytes that are
    no characters, are left to the library."""
    pieces, joins, dropped = _piece_bytes(data)
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values)), b"")
    library = np.zeros(len(ids), dtype=bool)
    library[np.searchsorted(offsets, np.flatnonzero(~joins[flat]), side="right") - 1] = True
    try:
        texts = joined.cast(pa.string())
        if dropped:
            texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
    except pa.ArrowInvalid:
        library[:] = True
        texts = pa.array([""] * len(ids), pa.string())
    if library.any():
        again = _built(data).decode_batch([x for x, due in zip(ids.to_pylist(), library) if due], skip_special_tokens=False)
        texts = pc.replace_with_mask(texts, pa.array(library), pa.array(again, pa.string()))
    return texts


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One line per row of docs: doc_id, ids, n_tokens. Null and empty texts have no ids. Rows may repeat or lack an id;
    further columns are ignored. Texts are encoded whole, and special tokens written in them are ordinary text."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column(1).fill_null(""), 0
            for call in _calls(texts):
                ids = encode_texts(sent.value, call)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(call)), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())], ["doc_id", "ids", "n_tokens"])
                first += len(call)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(resting(run), "doc_id long, ids array<int>, n_tokens int")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (doc_id, ids) with the text of the ids; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _built(sent.value)
            ids = batch.column(1).to_pylist()
            texts = iter(made.decode_batch([x for x in ids if x], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if x is None else next(texts) if x else "" for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(resting(run), "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One line per row of docs: doc_id, ids, n_tokens, text that the ids decode to, whole. whole: that is the text of
    docs (a model that normalises, and literal markers in a text, lose something). Rows as in encode()."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column(1).fill_null(""), 0
            for call in _calls(texts):
                ids = pa.array(encode_texts(sent.value, call), pa.list_(pa.int32()))
                back = decode_ids(sent.value, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(call)), ids, pc.list_value_length(ids), back, pc.equal(pa.array(call, pa.string()), back)], ["doc_id", "ids", "n_tokens", "text", "whole"])
                first += len(call)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(resting(run), "doc_id long, ids array<int>, n_tokens int, text string, whole boolean")


def parity(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id of the rows whose ids differ from those of the SentencePiece library; none is expected."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            differs = [a != b for a, b in zip(encode_texts(sent.value, texts), other.encode(texts, num_threads=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(differs, pa.bool_()))], ["doc_id"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(resting(run), "doc_id long")
