"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are cut into marked words (``▁`` runs go with the word after them). The
distinct marked words of a block are sorted, which lays them out as a trie in
depth-first order: going from one word to the next, the forward states of their
common prefix stay on the stack and only the rest is computed.

The forward state of a prefix depends on the kind of model:

* unigram: best score of any segmentation of the prefix, and its last piece (Viterbi);
* BPE: the last piece of the prefix's own encoding. A prefix encoding followed by a
  piece is again an encoding exactly if the two adjoining pieces, merged alone, come
  out as themselves; one piece fits at every position. Scores of a BPE model rank
  merges and are no likelihoods, so maximising their sum would not be its encoding.

Decoding joins the pieces' bytes, turns marks into spaces and drops the dummy prefix.

Defined results: null texts have null ids; the empty text has none; texts are encoded
whole, however long; repeated rows are encoded alike; an empty table gives an empty
table; further columns pass through, but ``ids``, ``n_tokens`` and ``round_trip``
replace any of that name. The model file is read on the driver and is of fixed size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Marked words and piece pairs that a worker remembers before it starts anew.
MEMORY = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Protocol buffer fields: number and value."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            i += size
            yield key >> 3, data[i - size : i]
        else:
            size = {1: 8, 5: 4}[kind]
            i += size
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[i - size : i])[0]


class Codec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map or white space removal are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.value = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # Line ends stand alone if no piece joins them to anything.
        alone = "" if "\n" in joined else "\\n"
        self.units = re.compile(".+" if inner else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""), re.DOTALL)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.least = min(self.scores, default=0.0) - 10.0

    # -- BPE pairs -----------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored adjacent pair first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; a = -1 asks if b is its own encoding."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            p, q = self.pieces[a] if a >= 0 else "", self.pieces[b]
            found = self.pairs[key] = self.merged(p + q) == ([p, q] if p else [q])
        return found

    # -- forward pass --------------------------------------------------------------
    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct marked words; sorted, so that each shares its prefix's states with the one before."""
        out: dict[str, tuple[int, ...]] = {}
        before, trie, fits, unigram = "", self.trie, self.fits, self.kind == UNIGRAM
        # By prefix length: the last piece (-1 for none, -2 for a character without piece), its start, its score, matches under way.
        last, start, score, live = [-1], [0], [0.0], [[]]
        for word in sorted(words):
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1 :], start[common + 1 :], score[common + 1 :], live[common + 1 :]
            for i in range(common, len(word)):
                c, going = word[i], []
                for j, node in live[i]:
                    nxt = node.get(c)
                    if nxt is not None:
                        going.append((j, nxt))
                nxt = trie.get(c)
                if nxt is not None:
                    going.append((i, nxt))
                piece, at, best = -2, i, None
                for j, node in going:  # longest first
                    k = node.get("")
                    if k is None:
                        continue
                    if unigram:
                        s = score[j] + self.scores[k]
                        if best is None or s > best:
                            piece, at, best = k, j, s
                    elif (last[j] == -2 and fits(-1, k)) or (last[j] != -2 and fits(last[j], k)):
                        piece, at = k, j
                        break
                if piece == -2 and unigram:
                    best = score[i] + self.least
                last.append(piece)
                start.append(at)
                score.append(best or 0.0)
                live.append(going)
            ids, i = [], len(word)
            while i:
                if last[i] >= 0:
                    ids.append(last[i])
                else:
                    raw = word[i - 1].encode("utf-8", "surrogatepass")
                    ids += [self.byte[b] for b in reversed(raw)] if self.byte else [self.unknown]
                i = start[i]
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.units.findall((MARK if self.dummy_prefix and t else "") + t.replace(" ", MARK)) for t in texts]
        fresh = set().union(*cut) - self.words.keys() if cut else set()
        if len(self.words) + len(fresh) > MEMORY:
            self.words.clear()
            fresh = set().union(*cut)
        self.words |= self.encode_words(list(fresh))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, units))) for units in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.value.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.dummy_prefix and raw.startswith(" ") else raw


_CODECS: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec a worker process, with what it remembers."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def text_blocks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """The documents with ``ids`` (array of int), ``n_tokens`` (long) and ``round_trip``: decoding gives the text again."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "n_tokens", "round_trip")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            all_texts = batch.column(column).to_pylist()
            for lo, hi in text_blocks(all_texts):
                texts = all_texts[lo:hi]
                ids = codec.encode([t or "" for t in texts])
                missing = np.array([t is None for t in texts], bool)
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(missing))
                trips = [None if t is None else codec.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                new = [lists, pa.array(sizes, mask=missing), pa.array(trips, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *new], names=[*batch.schema.names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Rows with ``ids`` get ``text``; null ids give null."""
    with open(model_path, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids):
        codec = codec_of(model.value)
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return tokens.withColumn("text", text_of("ids"))
