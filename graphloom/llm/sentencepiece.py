"""SentencePiece encoding and decoding over a trie of a batch's distinct marked words.

The trie is walked depth-first in sorted order, so a forward state is found once for each distinct prefix. For unigram
models the state is the Viterbi score and the last piece. Merge-rank (BPE) models have no score to maximise: there the
state is the last piece of the prefix's encoding, which is the one piece that is compatible with the encoding before
it (two pieces are compatible if merging their joined text gives just these two); a text's encoding is a chain of
compatible pieces, and the only one.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cached, load, ship

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
PART_CHARS, KNOWN, PAIRS, LONG_UNIT = 1 << 22, 200_000, 250_000, 4096
#: Bits of a piece's number in the walk of merge-rank models: the model's pieces, then all code points.
BITS = 22
#: Fixed values of the model format: kinds of pieces and the merge-rank model type.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, BPE = 1, 2, 3, 4, 5, 6, 2


def _shared(a: str, b: str) -> int:
    """The length of the prefix that two texts share."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same


class Codec:
    """A model file's pieces, with encoding of many texts at a time and decoding."""

    def __init__(self, path: str | None = None, *, model=None):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        if path is not None:
            model = sentencepiece_model_pb2.ModelProto()
            with open(path, "rb") as f:
                model.ParseFromString(f.read())
        self.normalizer = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pieces = [(p.piece, p.type) for p in model.pieces]
        own = [(i, p) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        self.ids, self.score = {p.piece: i for i, p in own}, {p.piece: p.score for _, p in own}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        self.merges = model.trainer_spec.model_type == BPE
        self.surface, self.prefix = model.trainer_spec.unk_surface or " ⁇ ", model.normalizer_spec.add_dummy_prefix
        spell = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else (self.surface if kind == UNKNOWN else p.replace(MARK, " ")).encode()
        self.spelled = [spell(p, kind) for p, kind in self.pieces]
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        self.known: dict[str, bytes] = {}  # words to little-endian 32-bit ids
        self.pairs: dict[int, bool] = {}  # two pieces' numbers to whether they are compatible
        self.empty = len(self.pieces) + 0x110000  # the number of no piece
        self.coded: dict[int, bytes] = {i: i.to_bytes(4, "little") for i in self.ids.values()}

    def merged(self, text: str) -> list[str]:
        """The merge-rank encoding by its definition: the best-scored neighbouring pair joins, the leftmost of equals."""
        parts, score = list(text), self.score
        if len(parts) < 32:
            none = float("-inf")
            ranks = [score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := max(ranks)) > none:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = score.get(parts[i - 1] + parts[i], none)
                if i < len(ranks):
                    ranks[i] = score.get(parts[i] + parts[i + 1], none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(-score[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or not parts[j] or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (new := parts[a] + parts[b]) in score:
                    heapq.heappush(queue, (-score[new], a, new))
        return [p for p in parts if p]

    def _text(self, number: int) -> str:
        """What a piece's number stands for: a piece of the model, or a character that is none."""
        if number == self.empty:
            return ""
        return self.pieces[number][0] if number < len(self.pieces) else chr(number - len(self.pieces))

    def compatible(self, pair: int) -> bool:
        """Whether merging the joined text of two pieces gives just them; with an empty first one, the second alone."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        a, b = self._text(pair >> BITS), self._text(pair & (1 << BITS) - 1)
        self.pairs[pair] = out = self.merged(a + b) == ([a, b] if a else [b])
        return out

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def units(self, texts: list[str]) -> list[list[str]]:
        return [UNITS.findall(self.normalizer.normalize(t)) for t in texts]

    def learn(self, words: list[str]) -> None:
        """Encodes distinct sorted words into `known`, keeping the forward states of the prefix shared with the one before."""
        if not self.merges:
            return self._learn_scored(words)
        last, codes = [self.empty], [b""]  # of each prefix, by its length: its last piece's number, and its ids
        held, number, pairs, coded, other = "", self.ids.get, self.pairs, self.coded, len(self.pieces)
        for word in words:
            if len(word) > LONG_UNIT:  # no word: one long run, encoded alone
                self.known[word] = np.array(self._ids(self.merged(word)), "<i4").tobytes()
                continue
            same = _shared(held, word)
            del last[same + 1 :], codes[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                # Just one piece is compatible, so the search may start from the short ones.
                start, found = end - 1, number(word[end - 1])
                if found is None:
                    found = other + ord(word[start])
                least = max(0, end - self.longest)
                while True:
                    if found is not None:
                        pair = last[start] << BITS | found
                        yes = pairs.get(pair)
                        if self.compatible(pair) if yes is None else yes:
                            break
                    start -= 1
                    if start < least:
                        break
                    found = number(word[start:end])
                if start < least:
                    break
                code = coded.get(found)
                if code is None:  # of a character that is no piece, not kept: there may be many
                    code = np.array(self._ids([word[start:end]]), "<i4").tobytes()
                last.append(found)
                codes.append(codes[start] + code)
            held = word[: len(last) - 1]
            # No compatible piece, as tied scores of a model might leave: then by the definition.
            self.known[word] = codes[-1] if len(held) == len(word) else np.array(self._ids(self.merged(word)), "<i4").tobytes()

    def _learn_scored(self, words: list[str]) -> None:
        """Viterbi: the best score and the last piece of each prefix."""
        last, best, held, score = [""], [0.0], "", self.score
        for word in words:
            same = _shared(held, word)
            del last[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                found, top = word[end - 1 : end], float("-inf")
                for start in range(max(0, end - self.longest), end):
                    piece = word[start:end]
                    s = score.get(piece, self.lowest if end - start == 1 else None)
                    if s is not None and best[start] + s > top:
                        found, top = piece, best[start] + s
                last.append(found)
                best.append(top)
            held, at, parts = word, len(word), []
            while at:
                parts.append(last[at])
                at -= len(last[at])
            self.known[word] = np.array(self._ids(parts[::-1]), "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = self.units(texts)
        distinct = {u for units in split for u in units}
        self.learn(sorted(u for u in distinct if u not in self.known))
        known = self.known
        out = [np.frombuffer(b"".join(map(known.__getitem__, units)), "<i4") for units in split]
        if len(known) > KNOWN:  # what these texts don't hold goes
            self.known = {u: known[u] for u in distinct} if len(distinct) <= KNOWN else {}
        return out

    def decode(self, ids) -> str:
        """The text of ids; byte pieces join to UTF-8, control pieces vanish, unknown ones show as the model's mark."""
        table, other = self.spelled, self.surface.encode()
        text = b"".join([table[i] if 0 <= i < len(table) else other for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _parts(texts: list[str]):
    """Slices of bounded text, so that a batch of long texts is encoded in several goes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _shape(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[1:]), more])


def encode(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """docs' `columns`, ids array<int> and ids_crc32 (of little-endian 32-bit ids) for every row of docs (text).

    Null texts count as empty and have no ids. Work is local to a task: no shuffle, and memory bounded by a slice of
    texts and a cache of words. path must be readable where the executors run.
    """

    def run(batches):
        codec = cached(f"pieces of {path}", lambda: Codec(path))
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(0)]
            for a, b in _parts(texts):
                found = codec.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                crc = pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), ids, crc], names=[*columns, "ids", "ids_crc32"])

    ship(docs.sparkSession)
    source = docs.select(F.col("text").alias("_text_"), *columns)
    return source.mapInArrow(run, _shape(source, "ids array<int>, ids_crc32 long"))


def decode(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """rows' `columns` and decoded string for every row of rows (ids); null ids count as none, null items as unknown."""

    def run(batches):
        codec = cached(f"pieces of {path}", lambda: Codec(path))
        for batch in batches:
            texts = [codec.decode(-1 if i is None else i for i in (x.as_py() or ())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*columns, "decoded"])

    ship(rows.sparkSession)
    source = rows.select(F.col("ids").alias("_ids_"), *columns)
    return source.mapInArrow(run, _shape(source, "decoded string"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    found = encode(docs, path, ["doc_id", "text_crc32"]).withColumn("n_ids", F.size("ids").cast("long"))
    back = decode(found, path, ["doc_id", "text_crc32", "n_ids", "ids_crc32"])
    return back.select("doc_id", "n_ids", "ids_crc32", (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))
