"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so merges never cross from a word into the
next marker: a marked text falls into chunks (markers, then a word) that are segmented apart. Each task keeps a table
of the distinct chunks it has met; a chunk is segmented once while it is in the table, and ids are joined back by
position. A table of the whole corpus would have to move every word occurrence through a shuffle, so it is one per
task, of at most TABLE entries (what is dropped is segmented again: no result depends on it).

That a model works so is checked when it is opened, on its pieces and on PROBES of white space and of what normalizers
change; texts are encoded whole by a model that fails them.

Defined results: a null or empty text has no ids and decodes to the empty text; very long texts are encoded whole, and
so are very long words, which aren't kept in the table; a null id is kept. Columns beside doc_id and text, whatever
their names, are not read; repeated rows give repeated results, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from showloom.llm.common import only, python_rows, small_batches

#: The space marker of such models.
MARK = "▁"
#: Entries of a task's table, and the longest chunk that it keeps.
TABLE, LONGEST = 200_000, 64
PROBES = ["", " ", "a", " a", "a ", "a  b", " a   b ", "a\tb\n c", "\u3000a\u3000\u00a0b", "Ａ １ ﬁ ½", "e\u0301 \u212b \u0130", "▁a ▁▁b", "a\u200bb\ufeffc", "x\x00 y", "a.b, c-d", "漢字 カナ", "😀 é"]
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """encode and decode as the library does for the model at path, by chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        bad = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
        self.mark_id = self.model.piece_to_id(MARK)
        self.table: dict[str, tuple[int, str, str]] = {}
        self.by_chunks = not bad
        self.by_chunks = self.by_chunks and all(self.whole(t) == found for t, found in zip(PROBES, [*self.run(PROBES)], strict=True))

    def whole(self, text: str | None) -> tuple[int, str, str]:
        """run() of one text, without chunks."""
        ids = self.model.encode(text or "")
        return len(ids), ",".join(map(str, ids)), self.model.decode(ids)

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """chunk -> number of ids, ids joined by commas, what they decode to after the first marker."""
        each = list(chunks)
        ids = [x or [self.mark_id] for x in self.model.encode([c[1:] for c in each], num_threads=1)]
        texts = self.model.decode(ids, num_threads=1) if each else []
        return {c: (len(i), ",".join(map(str, i)), t) for c, i, t in zip(each, ids, texts, strict=True)}

    def run(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, ids joined by commas, decoded text."""
        if not self.by_chunks:
            yield from map(self.whole, texts)
            return
        parts = [self.chunks(t or "") for t in texts]
        if len(self.table) > TABLE:
            self.table = {}
        found = self.segment({c for p in parts for c in p if c not in self.table})
        self.table |= found
        for p in parts:
            rows = [self.table[c] for c in p]
            yield sum([r[0] for r in rows]), ",".join([r[1] for r in rows]), " ".join([r[2] for r in rows])
        for c in found:
            if len(c) > LONGEST:
                del self.table[c]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text)."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for part, (texts,) in python_rows(batches, "text"):
            rows = [(n, sha(ids), sha(out)) for n, ids, out in codec.run(texts)]
            n, ids, out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
