"""SentencePiece encoding and decoding by a distinct-chunk table (operator 8).

For a model whose normaliser is the identity, which escapes spaces to the marker U+2581, adds a
dummy prefix and keeps every space, and none of whose pieces holds a marker after another
character, no merge crosses the start of a marker run. A text is then a sequence of chunks (one or
more markers and what follows up to the next marker) and its ids are the chunks' ids in order. Each
task keeps a table chunk -> (ids, decoded text), asks the library once for each distinct chunk and
joins the ids back by position; decoded text is kept only where it is not the chunk's own. The table is emptied when it holds ``TABLE_CHARS`` characters, which
bounds memory and changes no result. A model of another kind is given whole texts.

Null and empty texts have the begin and end ids only and decode to "". Texts of any length are encoded
whole; rows that repeat are answered each; an empty table stays empty. Columns of other names pass
through ``encode_column`` unchanged; if one has the name of a result column, it is replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

MARK = "▁"
TABLE_CHARS = 5_000_000
BATCH_TEXTS = 256
_CHUNK = re.compile(" +[^ ]*")
_LOADED: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sp.SentencePieceProcessor(model_file=model_path)
        spec = pb.ModelProto()
        spec.ParseFromString(self.sp.serialized_model_proto())
        n = spec.normalizer_spec
        self.chunked = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in spec.pieces)
        self.begin, self.end = (array("I", [i]).tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.mark = self.sp.piece_to_id(MARK)
        self.pieces = [p.piece for p in spec.pieces]
        self.table: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    @classmethod
    def of(cls, model_path: str) -> "Codec":
        if model_path not in _LOADED:
            _LOADED[model_path] = cls(model_path)
        return _LOADED[model_path]

    def forget(self) -> None:
        """Empties the table, when it is full and when a task ends: workers go on to other stages."""
        self.table, self.odd, self.held = {}, {}, 0

    def _fill(self, chunks: list[str]) -> None:
        """Segments and decodes chunks that the table lacks, in one call of the library."""
        for chunk, ids in zip(chunks, self.sp.encode(chunks, num_threads=1), strict=True):
            # the dummy prefix is the chunk's first marker; before nothing the library adds none
            ids = ids if chunk else [self.mark]
            self.table[chunk] = array("I", ids).tobytes()
            if "".join([self.pieces[i] for i in ids])[1:].replace(MARK, " ") != chunk:
                decoded = self.sp.decode(ids)
                if decoded != chunk:
                    self.odd[chunk] = decoded
            self.held += len(chunk) + 12

    def run_all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as native unsigned 32-bit integers with begin and end, and the decoded text."""
        if not self.chunked:
            every = [self.sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]
            return [(array("I", ids).tobytes(), self.sp.decode(ids)) for ids in every]
        texts = [(t or "").replace(MARK, " ") for t in texts]
        # a chunk stands without its first marker and with spaces for the others
        split = [[c[1:] for c in _CHUNK.findall(" " + t)] if "  " in t or t[:1] == " " or t[-1:] == " " else t.split(" ") if t else [] for t in texts]
        if self.held > TABLE_CHARS:
            self.forget()
        get = self.table.__getitem__
        out = []
        for text, chunks in zip(texts, split, strict=True):
            try:
                ids = b"".join(map(get, chunks))
            except KeyError:
                self._fill(list(set().union(*split).difference(self.table)))
                ids = b"".join(map(get, chunks))
            # a decoded chunk is its own text unless the table says otherwise
            if self.odd and not self.odd.keys().isdisjoint(chunks):
                decoded = " ".join([self.odd.get(c, c) for c in chunks])
            else:
                decoded = text
            out.append((self.begin + ids + self.end, decoded))
        return out


def encode_column(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ids (array<int>, begin and end included) and decoded (string) to each row."""
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c not in ("ids", "decoded")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = Codec.of(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(i, BATCH_TEXTS)
                got = codec.run_all(part.column(text).to_pylist())
                ends = np.cumsum([0] + [len(g[0]) // 4 for g in got])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(g[0] for g in got), dtype=np.uint32).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, pa.array([g[1] for g in got], pa.string())], names=[*keep, "ids", "decoded"])
        codec.forget()

    return df.mapInArrow(released(run), schema)


def encode_digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row, as ``encode_column`` would give them."""

    def run(batches):
        import pyarrow as pa

        codec = Codec.of(model_path)
        for batch in batches:
            n, a, b = [], [], []
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                for ids, decoded in codec.run_all(batch.column("_text").slice(i, BATCH_TEXTS).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(released(run), f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_key", key)
