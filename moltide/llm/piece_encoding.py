"""SentencePiece encoding with the original byte span of every piece, and decoding.

The text is normalised here, not in the library: at each position the longest prefix that the model's compiled character
map (a double-array trie and a table of replacements) knows is replaced, other characters stay, and every normalised
byte keeps the original byte it came from. The library then splits the normalised text with the model's own pieces and
without its normaliser; no piece crosses from a word into the space before the next, so words are split apart and
remembered. Piece lengths add up to positions in the normalised text, and the alignment projects these to original bytes.

A null text is an empty one, which has no ids. Equal rows are kept. A null id stays null; an empty table gives no rows.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SPACE = "▁"
#: Bytes of words and their ids, as counted here, that a worker remembers.
REMEMBERED, ENTRY = 96 << 20, 250


class CharacterMap:
    """A compiled character map: 4 bytes of trie size, the trie's units, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:], and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self.base(0, units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node = self.base(node, unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return found

    @staticmethod
    def base(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


class OffsetEncoder:
    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        self.library = SentencePieceProcessor(model_proto=proto)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap or not self.escape:
            raise ValueError("models with spaces as suffixes, unescaped spaces or a denormaliser aren't supported")
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces)
        model.normalizer_spec.Clear()
        spec = model.normalizer_spec
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, True
        self.splitter = SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = model.ModelProto.SentencePiece if hasattr(model, "ModelProto") else type(model.pieces[0])
        self.widths = [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces]
        self.unknown = self.library.unk_id()
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.held = 0

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, spaces as U+2581, and for each of its bytes and its end the original byte it comes from."""
        raw = text.encode()
        if not self.map.units and not self.squeeze:
            body = text.replace(" ", SPACE)
            widths = np.where(np.frombuffer(raw, np.uint8) == 32, 3, 1)
            source = np.append(np.repeat(np.arange(len(raw)), widths), len(raw))
            return (SPACE + body, np.concatenate([np.zeros(3, np.int64), source])) if self.prefix and text else (body, source)
        out, source, at = [], [], 0
        while at < len(raw):
            if got := self.map.longest(raw, at):
                n, new = got
            else:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                new = raw[at : at + n]
            out.append(new)
            source.append(at)
            at += n
        chars = [(c, s) for new, s in zip(out, source, strict=True) for c in new.decode()]
        if self.squeeze:
            kept: list[tuple[str, int]] = []
            for c, s in chars:
                if c != " " or kept and kept[-1][0] != " ":
                    kept.append((c, s))
            end = len(raw)
            while kept and kept[-1][0] in (" ", SPACE):
                end = kept.pop()[1]
            chars = kept
        else:
            end = len(raw)
        if self.prefix and chars:
            chars.insert(0, (" ", chars[0][1]))
        text = "".join(c for c, _ in chars).replace(" ", SPACE)
        widths = [len(c.encode()) if c != " " else 3 for c, _ in chars]
        return text, np.append(np.repeat(np.array([s for _, s in chars], np.int64), widths), end)

    def words(self, normal: str) -> list[str]:
        """Stretches that no piece crosses, each from a space that follows another character, without that space."""
        if not self.apart:
            return [normal[1:]] if normal[:1] == SPACE else []
        if SPACE * 2 not in normal and normal[:1] == SPACE:
            return normal.split(SPACE)[1:]
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", normal)] if normal[:1] == SPACE else []

    def split(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Ids and widths in normalised bytes (little-endian 32-bit numbers), and ids as decimals, of each segment."""
        out = []
        for s, ids in zip(segments, self.splitter.encode(segments, out_type=int, num_threads=1), strict=True):
            widths = [self.widths[i] for i in ids]
            if self.unknown in ids:
                widths = [len(p.surface.encode()) for p in self.splitter.encode(s, return_type="proto").pieces]
            out.append((array("i", ids).tobytes(), array("i", widths).tobytes(), ",".join(map(str, ids)).encode()))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """For each text its ids, the original byte at which each piece begins and ends, and the ids as decimals."""
        known, found, missing = self.known, [], set()
        for t in texts:
            normal, source = self.normalise(t)
            words = self.words(normal)
            if normal and not words:  # a text that does not begin with a space is split as a whole
                found.append((source, None, self.split([normal])))
                continue
            got = list(map(known.get, words))
            if None in got:
                missing.update(w for w, g in zip(words, got, strict=True) if g is None)
            else:
                words = None
            found.append((source, words, got))
        now, new = {}, list(missing)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            now.update(zip(part, self.split([SPACE + w for w in part]), strict=True))
        if (size := sum(ENTRY + 12 * len(w) for w in new)) + self.held > REMEMBERED:
            known.clear()
            self.held = 0
        if size <= REMEMBERED:
            known.update(now)
            self.held += size
        for source, words, got in found:
            if words:
                got = [now[w] if g is None else g for w, g in zip(words, got, strict=True)]
            ids = np.frombuffer(b"".join([g[0] for g in got]), "<i4")
            ends = np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), "<i4"), dtype=np.int64)
            edges = source[np.append(0, ends)] if len(ids) else source[:1]
            yield ids, edges[:-1], edges[1:], b",".join([g[2] for g in got])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@cache
def encoder(path: str) -> OffsetEncoder:
    return OffsetEncoder(path)


def encode_column(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins and ends (the original byte span of each piece) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            rows = [(i.tolist(), b.tolist(), e.tolist()) for i, b, e, _ in encoder(model).encode([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]], ["doc_id", "ids", "begins", "ends"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spanned_bytes (original bytes inside piece spans) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(model)
        for batch in slices(batches, 1):
            n, a, b, spanned = [], [], [], []
            for ids, begin, end, decimals in enc.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(decimals).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids.tolist()).encode()).hexdigest())
                spanned.append(int((end - begin).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(spanned, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long")


def op9_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
