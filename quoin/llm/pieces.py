"""SentencePiece BPE ids by a prefix table, and back.

For every prefix of a text, the last token of the prefix's encoding is unique: among the pieces that
end there (found by one Aho-Corasick automaton over all pieces), it is the one whose pair with the last
token before it encodes to just that pair. A table with one token for each prefix is filled from left to
right and the ids are read from its end backwards. Whether a pair is compatible is found by merging its
text once, and kept.

No piece holds a word mark after another character, so a text may be cut before every run of word
marks; equal cuts are encoded once and a bounded number of them is kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import ChainMap

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
_HELD: dict[str, "PrefixTable"] = {}


class PrefixTable:
    def __init__(self, path: str, limit: int = 500_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and train.byte_fallback):
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and no normalisation")
        kinds = {p.type for p in model.pieces}
        if not kinds <= {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not handled")
        self.text = [p.piece for p in model.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.special = {i: "" if p.type == 3 else " ⁇ " for i, p in enumerate(model.pieces) if p.type in (2, 3)}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.id):
            raise ValueError("a piece holds a word mark after another character")
        # characters that only longer pieces hold take part in merges; they have no id of their own
        for c in sorted({c for p in self.id for c in p} - self.id.keys()):
            self.id[c] = len(self.text)
            self.text.append(c)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.chars = {p for p in self.id if len(p) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.limit, self.kept, self.odd, self.runs = limit, {}, {}, {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first and leftmost among equals."""
        n = len(text)
        part, nxt, prv = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if part[i] is None or part[i] != a or nxt[i] != j or part[j] != b:
                continue
            part[i], part[j], nxt[i] = a + b, None, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in part if p is not None]

    def _fits(self, a: int, b: int) -> bool:
        x, y = self.text[a], self.text[b]
        if len(self.pairs) >= 4 * self.limit:
            self.pairs.clear()
        got = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return got

    def _stands(self, a: int) -> bool:
        got = self.alone[a] = self.merge(self.text[a]) == [self.text[a]]
        return got

    def _segment(self, text: str) -> list[int]:
        """Ids of a text without word-mark runs and of characters that pieces have."""
        last, pairs, alone, done = [-1] * (len(text) + 1), self.pairs, self.alone, -1
        size = [0] * (len(text) + 1)
        for end, (t, n) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                key = (last[start], t)
                ok = pairs.get(key)
                if ok is None:
                    ok = self._fits(*key)
            else:
                ok = alone.get(t)
                if ok is None:
                    ok = self._stands(t)
            if ok:
                last[end + 1], size[end + 1], done = t, n, end
        ids, j = [], len(text)
        while j:
            ids.append(last[j])
            j -= size[j]
        ids.reverse()
        return ids

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode("utf-8", "replace")]

    def _word(self, word: str) -> list[int]:
        """Ids of one word mark and a word."""
        text, ids, at = MARK + word, [], 0
        for i, c in enumerate(text):
            if c not in self.chars:
                if i > at:
                    ids += self._segment(text[at:i])
                ids += self._bytes(c)
                at = i + 1
        if at < len(text):
            ids += self._segment(text[at:])
        n = len(self.text)
        return [x for i in ids for x in ([i] if i < n and self.text[i] in self.score or i in self.byte_of else self._bytes(self.text[i]))]

    def _spaced(self, chunk: str) -> list[int]:
        """Ids of a run of word marks and a word. Runs merge last of all, so the word takes the last
        mark if it can, and what is left of the run merges by itself."""
        word = chunk.lstrip(" ")
        n = len(chunk) - len(word)
        ids = self._word(word)
        if n > 1:
            if ids[0] == self.id[MARK]:
                ids = ids[1:]
            else:
                n -= 1
            run = self.runs.get(n) or [self.id[p] for p in self.merge(MARK * n)]
            if n <= 1024:  # longer runs of spaces are rare and not kept
                self.runs[n] = run
            ids = run + ids
        return ids

    def chunks(self, text: str) -> list[str]:
        """Spaces and word marks are the same; each chunk is a run of them and a word. A chunk of one
        mark is given without it."""
        text = text.replace(MARK, " ")
        if "  " in text or text.startswith(" "):
            return [c[1:] if c[1:2] != " " else c for c in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for c in self.chunks(text) for i in (self._spaced(c) if c[:1] == " " else self._word(c))]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte tokens form UTF-8, the leading mark goes."""
        out, raw, lead = [], bytearray(), True
        for i in ids:
            if self.special.get(i) == "":
                continue
            if lead:
                lead = False
                if i not in self.byte_of and self.text[i].startswith(MARK):
                    out.append(self.text[i][1:])
                    continue
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.special.get(i, self.text[i]))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(MARK, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        parts = self.chunks(text)
        kept = self.kept
        out = list(map(kept.get, parts))
        odd = self.odd
        if None in out:
            found, strange = {}, {}
            for p in {p for p, v in zip(parts, out) if v is None}:
                ids = self._spaced(p) if p[:1] == " " else self._word(p)
                found[p] = ",".join(map(str, ids)).encode()
                back = self.decode(ids)
                if back != (p[1:] if p[:1] == " " else p):
                    strange[p] = back
            out = [found[p] if v is None else v for p, v in zip(parts, out)]
            if len(kept) < self.limit:
                kept.update((p, v) for p, v in found.items() if len(p) <= 48)
                self.odd.update((p, v) for p, v in strange.items() if len(p) <= 48)
            if strange:
                odd = ChainMap(strange, self.odd)
        if odd and any(p in odd for p in parts):
            back = " ".join(odd.get(p, p[1:] if p[:1] == " " else p) for p in parts)
        else:
            back = text.replace(MARK, " ")
        joined = b",".join(out)
        return joined.count(b",") + 1, hashlib.sha256(joined).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _utf8(raw: bytes) -> str:
    """Each byte that is not part of valid UTF-8 becomes one replacement character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def prefix_table(path: str | None = None) -> PrefixTable:
    path = path or public_tokenizers.path(PIECE_BPE)
    if path not in _HELD:
        _HELD[path] = PrefixTable(path)
    return _HELD[path]


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids``; a null or empty text has none."""

    def run(batches):
        held = prefix_table(path)
        for batch in batches:
            ids = [held.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The texts of a column ``ids``; null ids are an empty text."""

    def run(batches):
        held = prefix_table(path)
        for batch in batches:
            text = [held.decode(i.as_py() or []) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text for each row of ``docs`` (``doc_id``, ``text``; others are not
    read). Null and empty texts have no ids and decode to an empty text; null ids and repeated rows
    are kept; an empty table gives no row. One pass, no shuffle."""

    def run(batches):
        held = prefix_table(path)
        for batch in batches:
            n, ids, back = zip(*[held.digest(t.as_py() or "") for t in batch.column("text")]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
