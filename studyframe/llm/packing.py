"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents become ids where they are read, cut into pieces of at most a sequence, and pieces are dealt by hash to
groups of bounded size. Within a group pieces go by falling length, each into the first sequence with room: a
tree over the sequences, whose nodes hold the largest room below them, finds that one in a step per level. What is
then far from full is laid end to end and cut again, into full sequences and powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm.textkernel import SPACE, resting

SEQUENCE, END = 4096, 2
#: Documents, and bytes of text, that a group holds on average.
GROUP_DOCS, GROUP_BYTES = 2048, 8 << 20
#: Room that may stay empty in a sequence that is full otherwise.
SMALL_ROOM = 64
#: Bytes of text that are turned into ids at once.
CALL_BYTES = 2 << 20
#: Word parts that a worker remembers; beyond that the less used half is forgotten, and encoded again when met.
KNOWN_PARTS = 400_000

# The steps of the one kind of tokenizer file whose words can be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Signs of ASCII that make parts of their own; an apostrophe may also begin one of letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that stand for bytes in such a file's vocabulary: printable ones for themselves, the rest from 256 on.
SPELLED = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Kinds of bytes: white space, letters, digits, signs, and what the tokenizer has to cut itself.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[33:127], KIND[48:58], KIND[65:91], KIND[97:123], KIND[39], KIND[SPACE] = SIGN, DIGIT, LETTER, LETTER, OTHER, BLANK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Encoder:
    """Ids of texts by a tokenizer file; where its steps allow that, each distinct part of a word is encoded once.

    White space separates in such a file, and nothing before or after a word counts. Words of ASCII and Latin-1
    letters, digits and signs are cut here, all at once, where the kind of byte changes; others go to the tokenizer
    whole, as do parts with a sign that begins a special token."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.model = self.tokenizer.model
        given = json.loads(spec)
        self.marks = [t["content"] for t in given.get("added_tokens", [])]
        settings = given["model"]
        self.wordwise = (
            all(given.get(k) == v for k, v in WORDWISE.items())
            and settings["type"] == "BPE"
            and not (settings.get("dropout") or settings.get("ignore_merges") or settings.get("continuing_subword_prefix"))
            and not given.get("truncation")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in given.get("added_tokens", []))
        )
        signs = "".join(re.escape(c) for c in SIGNS if not any(m.startswith(c) for m in self.marks))
        self.part = re.compile(f"[a-zß-öø-ÿ]+|[0-9]|[{signs}]+")
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget(0)

    def _forget(self, keep: int) -> None:
        """Remember the `keep` most used parts only."""
        if not keep:
            self.known, self.used = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
            self.starts, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=self.kind)
        elif len(self.known) > keep:
            best = np.sort(np.argpartition(-self.used, keep)[:keep])
            sizes = np.diff(self.starts)
            self.ids = self.ids[np.repeat(np.isin(np.arange(len(sizes)), best), sizes)]
            self.known, self.used, self.starts = self.known.take(pa.array(best)), self.used[best] // 2, np.concatenate([[0], np.cumsum(sizes[best])])

    def _learn(self, parts: pa.StringArray) -> None:
        words = parts.to_pylist()
        other = [p for p in words if not self.part.fullmatch(p)]
        known = dict(zip(other, (e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False))))
        ids = [known[p] if p in known else [t.id for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(SPELLED))] for p in words]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.known = pa.concat_arrays([self.known, parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), dtype=self.kind, count=sizes.sum())])
        self.used = np.append(self.used, np.zeros(len(ids), dtype=np.int64))

    def _ids_of_parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and where those of each end."""
        found = parts.dictionary_encode()
        at, distinct = found.indices.to_numpy(), found.dictionary
        code = pc.index_in(distinct, value_set=self.known)
        if len(self.known) + code.null_count > KNOWN_PARTS:
            self._forget(KNOWN_PARTS // 2)
            code = pc.index_in(distinct, value_set=self.known)
        first, new = len(self.known), code.is_null().to_numpy(zero_copy_only=False)
        self._learn(distinct.filter(pa.array(new)))
        code = code.fill_null(0).to_numpy().astype(np.int64)
        code[new] = first + np.arange(new.sum())
        self.used[code] += np.bincount(at, minlength=len(code))
        sizes = np.diff(self.starts)[code].astype(np.int32)[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.repeat(self.starts[code][at] - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.ids[place], ends

    def _parts(self, data: np.ndarray, firsts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Parts of the words in data, and the byte at which each begins. At `firsts` a word ends if it has not."""
        kind, lower = KIND[data], LOWER[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[(data[second] != 0x97) & (data[second] != 0xB7)]  # the signs among Latin-1 letters
        kind[second] = kind[second - 1] = LETTER
        lower[second] += np.where(data[second] < 0x9F, 32, 0).astype(np.uint8)
        blank = kind == BLANK
        begins = ~blank
        begins[1:] &= blank[:-1]
        begins[firsts] = ~blank[firsts]
        words = np.flatnonzero(begins)
        other = kind == OTHER
        for mark in self.marks:
            a, b = mark.encode()[:2]
            other[:-1] |= (data[:-1] == a) & (data[1:] == b)
        odd = np.add.reduceat(other, words, dtype=np.int32) > 0 if len(words) else np.zeros(0, dtype=bool)
        odd = np.concatenate([np.zeros(words[0] if len(words) else len(data), dtype=bool), np.repeat(odd, np.diff(np.append(words, len(data))))])
        inner = kind == DIGIT
        inner[1:] |= kind[1:] != kind[:-1]
        begins |= inner & ~blank & ~odd
        starts = np.flatnonzero(begins)
        letters = np.where(odd, data, lower)[~blank]
        place = np.cumsum(~blank, dtype=np.int32)[starts] - np.int32(1)
        offsets = np.append(place, np.int32(len(letters))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), starts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, each text's followed by END, one after the other, and where each text begins (and the last ends)."""
        if not self.wordwise:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            bounds = np.cumsum([0, *(len(x) + 1 for x in found)])
            return np.fromiter((i for x in found for i in (*x, END)), dtype=self.kind, count=bounds[-1]), bounds
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        parts, starts = self._parts(data, offsets[:-1][np.diff(offsets) > 0])
        ids, ends = self._ids_of_parts(parts)
        ends = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return np.insert(ids, ends[1:], END), ends + np.arange(len(ends))


def _read(path: str) -> bytes:
    source, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with source.open_input_stream(place) as stream:
        return stream.read()


_MADE: dict[bytes, Encoder] = {}


def _encoder(spec: bytes) -> Encoder:
    if spec not in _MADE:
        _MADE.clear()
        _MADE[spec] = Encoder(spec)
    return _MADE[spec]


def _calls(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """first and last row (exclusive) of runs of about CALL_BYTES; a longer text is a run of its own."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CALL_BYTES, side="right")) - 1)
        yield first, last
        first = last


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, doc_tokens, width, ids (little-endian, unsigned, of `width` bytes) of each row, cut every `sequence` ids.

    The width follows from the vocabulary and is 2 or 4."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.string())
            for first, last in _calls(texts):
                ids, bounds = encoder.encode(texts.slice(first, last - first))
                tokens = np.diff(bounds)
                count = -(-tokens // sequence)
                row = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * sequence
                width = ids.itemsize
                edges = np.append(bounds[row] + start, bounds[-1]) * width
                cut = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
                for at in range(0, len(row), 8192):
                    some = row[at : at + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(first + some)), pa.array(start[at : at + 8192]), pa.array(tokens[some]), pa.array(np.full(len(some), width, dtype=np.int32)), cut.slice(at, 8192).cast(pa.binary())],
                        ["doc_id", "start", "doc_tokens", "width", "ids"],
                    )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(resting(run), "doc_id long, start long, doc_tokens long, width int, ids binary")


def first_fit(sizes: list[int], room: int) -> list[int]:
    """For sizes in the order given, none above room: the number of the first bin with room for each."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)
    out = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out.append(at - leaves)
        left = tree[at] = tree[at] - size
        while at > 1:
            other = tree[at ^ 1]
            at //= 2
            left = max(left, other)
            if tree[at] == left:
                break
            tree[at] = left
    return out


def pack_sizes(sizes: np.ndarray, room: int = SEQUENCE, small: int = SMALL_ROOM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the given sizes, longest first, in bins: parallel arrays of piece, first and last id of it, bin, offset.

    Bins by first fit; those with more than `small` room left, and no power of two in them, are laid end to end and
    cut into full bins and, for the rest, powers of two.
    """
    bins = np.array(first_fit(sizes.tolist(), room), dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    bins, sizes = bins[order], sizes[order]
    ends = np.cumsum(sizes)
    opens = np.flatnonzero(np.diff(bins, prepend=-1))
    totals = np.add.reduceat(sizes, opens) if len(sizes) else sizes
    offset = ends - sizes - np.repeat((ends - sizes)[opens], np.diff(np.append(opens, len(sizes))))
    loose = (room - totals > small) & (totals & (totals - 1) != 0)
    again = np.repeat(loose, np.diff(np.append(opens, len(sizes))))
    fixed = order[~again], np.zeros((~again).sum(), dtype=np.int64), sizes[~again], bins[~again], offset[~again]
    if not again.any():
        return fixed
    piece, size = order[again], sizes[again]
    total, edge = int(size.sum()), np.concatenate([[0], np.cumsum(size)])
    rest = total % room
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    starts = np.cumsum([0, *[room] * (total // room), *powers])
    cuts = np.unique(np.concatenate([edge, starts]))  # every stretch between two cuts is of one piece and in one bin
    a, b = cuts[:-1], cuts[1:]
    which, where = np.searchsorted(edge, a, side="right") - 1, np.searchsorted(starts, a, side="right") - 1
    new = piece[which], a - edge[which], b - edge[which], bins.max() + 1 + where, a - starts[where]
    return tuple(np.concatenate(x) for x in zip(fixed, new))


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece of every row of docs.

    A row's ids are those of its text (null: empty) and END; so every row has a piece. Rows may repeat or lack an id:
    each is a document of its own. Further columns are ignored. Pieces are whole documents, or stretches of `sequence`
    ids and their rest, but for those of sequences that had to be cut again. The group of a piece follows from its id,
    place, content and input partition, so a lost task deals its pieces as before, and not even copies of one row meet
    in one group beyond what one partition had. An empty table gives no pieces.
    """
    # A sequence is padded to its full length unless its ids are a power of two.
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    groups = max(1, -(-rows // group_docs), -(-size // group_bytes))
    key = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids"), F.spark_partition_id()), F.lit(groups))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        width = table["width"][0].as_py()
        sizes = pc.binary_length(table["ids"]).to_numpy().astype(np.int64) // width
        table = table.take(pa.array(np.lexsort((table["start"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy(), -sizes))))
        ids, sizes = table["ids"].to_pylist(), np.sort(sizes)[::-1]
        piece, first, last, bins, offset = pack_sizes(sizes, sequence)
        cut = [np.frombuffer(ids[p], f"<u{width}", b - a, a * width).astype("<u4").tobytes() for p, a, b in zip(piece.tolist(), first.tolist(), last.tolist())]
        taken = table.select(["doc_id", "start", "doc_tokens", "pack_group"]).take(pa.array(piece))
        start = taken["start"].to_numpy() + first
        number = taken["pack_group"].to_numpy() * (1 << 32) + bins
        return pa.table({"doc_id": taken["doc_id"], "start": start, "ids": pa.array(cut, pa.binary()), "doc_tokens": taken["doc_tokens"], "sequence_id": number, "offset": offset})

    dealt = pieces(docs, tokenizer_path, sequence).withColumn("pack_group", key)
    return dealt.groupBy("pack_group").applyInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
