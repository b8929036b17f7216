"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding is exact and by backtracking: an Aho-Corasick automaton gives the
longest vocabulary piece at each place, a token is appended only if merging the
text of the last token and the new one again gives these two tokens, shorter
pieces are tried when that fails, and a bit field remembers places from which
no completion exists. Texts are cut between characters that stand side by side
in no piece (as a letter and a word mark), since no merge can cross such a place,
and each distinct stretch of a slice is encoded once.

Defined results: null and empty texts give only the begin and end ids;
characters that the model lacks become their UTF-8 byte pieces; repeated rows
are encoded alike; an empty table gives an empty result; other columns are
ignored, whatever their names. Memory is bounded by one slice of text and two
caches: `CACHE_BYTES` of short stretches (longer ones are not kept), `CACHE_PAIRS` pairs.
"""

from __future__ import annotations

import gc
import hashlib
import heapq

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

MARK = "▁"
#: Bytes of cached stretches with their ids, what Python adds to each included; the longest stretch that is cached; cached pairs.
CACHE_BYTES, CACHE_LENGTH, ENTRY_BYTES = 24 << 20, 64, 200
CACHE_PAIRS = 150_000
SLICE = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if wire == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """Pieces, scores and kinds of a model file, with what encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(raw):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or spec.get(2) or spec.get(4, 1) or not spec.get(3, 1):
            raise ValueError("only merge models with byte fallback, a dummy prefix and no normalisation are handled")
        if any(k in (USER, UNUSED) for k in self.kinds) or any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL):
            raise ValueError("the model has pieces that cross word marks, or pieces of the user's or unused ones")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.cut = np.ones((256, 256), bool)  # by two bytes: no piece has these two, or a character with them, side by side
        for p in self.ids:
            for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:]):
                self.cut[slice(128, 256) if a > "\x7f" else ord(a), slice(128, 256) if b > "\x7f" else ord(b)] = False
        self.cut[128:, 128:] = False
        self.sizes = {i: len(p) for p, i in self.ids.items()}
        self.shorter: dict[int, int] = {}  # by piece, the longest piece that it begins with
        self.joined: dict[int, int] = {}  # by two pieces, the piece that their texts make together
        for p, i in self.ids.items():
            for k in range(len(p) - 1, 0, -1):
                if (left := self.ids.get(p[:k])) is not None:
                    self.shorter.setdefault(i, left)
                    if (right := self.ids.get(p[k:])) is not None:
                        self.joined[left << 21 | right] = i
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.words: dict[bytes, np.ndarray] = {}

    # -- encoding

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Merges of text in the model's order: best score first, then leftmost. steps gets the pairs merged."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (both := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[both]], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one; None if merging its text doesn't end in it."""
        if i not in self.split:
            last: list[tuple[str, str]] = []
            whole = i < len(self.pieces) and len(self.pieces[i]) > 1 and self.merge(self.pieces[i], last) == [self.pieces[i]]
            self.split[i] = (self.piece_id(last[-1][0]), self.piece_id(last[-1][1])) if whole else None
        return self.split[i]

    def piece_id(self, piece: str) -> int:
        """Its id; for a character without a piece a number beyond all ids."""
        found = self.ids.get(piece)
        return len(self.pieces) + ord(piece) if found is None else found

    def agree(self, left: int, right: int) -> bool:
        """Whether merging both texts together again leaves these two pieces.

        The merges inside both are undone from the latest to the first. At each
        state the two pieces that then touched must not have had a merge of
        their own that was due earlier: a better score, or the same one further left.
        """
        scores, joined = self.scores, self.joined
        due, tie = -float("inf"), False  # score of the merge undone last; whether an equal one across the border came first
        while True:
            across = joined.get(left << 21 | right)
            if across is not None and (scores[across] > due or tie and scores[across] == due):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and scores[left] < scores[right]:
                due, tie, left = scores[left], False, a[1]
            else:
                due, tie, right = scores[right], True, b[0]

    def _backtrack(self, word: str) -> list[int] | None:
        n = len(word)
        longest = [-1] * n
        for end, (size, i) in self.auto.iter(word):
            longest[end + 1 - size] = i  # ends only grow, so the longest piece comes last
        if -1 in longest:
            longest = [len(self.pieces) + ord(c) if i < 0 else i for i, c in zip(longest, word, strict=True)]
        sizes, shorter, pairs, failed = self.sizes, self.shorter, self.pairs, bytearray(n + 1)  # failed: places from which no valid completion exists
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            while piece >= 0:
                to = at + sizes.get(piece, 1)
                if not failed[to]:
                    if last < 0:
                        break
                    key = last << 21 | piece
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        good = pairs[key] = self.agree(last, piece)
                    if good:
                        break
                piece = shorter.get(piece, -1)
            if piece >= 0:
                out.append(piece)
                if to == n:
                    return out
                at, piece, last = to, longest[to], piece
            else:
                failed[at] = 1
                if not out:
                    return None
                piece = out.pop()
                at -= sizes.get(piece, 1)
                piece = shorter.get(piece, -1)
                last = out[-1] if out else -1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one stretch between cuts."""
        found = None
        if word != MARK and not word.startswith(MARK * 2):  # pieces of marks share one score, so their order is by place alone
            found = self._backtrack(word)
        if found is None:
            found = [self.piece_id(p) for p in self.merge(word)]
        if max(found) < len(self.pieces):
            return found
        return [j for i in found for j in ([i] if i < len(self.pieces) else [self.byte_id[b] for b in chr(i - len(self.pieces)).encode()])]

    def word(self, raw: bytes) -> np.ndarray:
        """Ids of a stretch given as UTF-8 in which a space stands for the mark."""
        found = self.words.get(raw)
        if found is None:
            found = np.array(self.encode_word(raw.decode().replace(" ", MARK)), np.uint32)
            if len(raw) <= CACHE_LENGTH:
                if len(self.words) * (ENTRY_BYTES + CACHE_LENGTH) >= CACHE_BYTES:
                    self.words.clear()
                self.words[raw] = found
        return found

    def encode_slice(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first place among them (one entry more)."""
        n = len(t)
        sizes = np.diff(t.offs)
        filled = np.flatnonzero(sizes)
        raw = bytearray()
        if t.data.tobytes().find(MARK.encode()) >= 0:  # marks in the text count as spaces do
            parts = [t.raw(i).replace(MARK.encode(), b" ") for i in range(n)]
        else:
            parts = None
        if parts is not None:
            raw = b"".join(b" " + p for p in parts if p)
            sizes = np.array([len(p) for p in parts])
            data = np.frombuffer(raw, np.uint8)
        else:
            data = np.insert(t.data, t.offs[:-1][filled], 32)
        text_start = np.zeros(len(filled) + 1, np.int64)
        np.cumsum(sizes[filled] + 1, out=text_start[1:])
        begins = np.zeros(len(data), bool)
        if len(data):
            begins[1:] = self.cut[data[:-1], data[1:]]
            begins[text_start[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        key = T.range_hash(T.byte_prefix(data), start, end)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        whole = data.tobytes()
        made = [self.word(whole[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        size = np.array([len(x) for x in made], np.int64)
        table = np.concatenate(made) if made else np.empty(0, np.uint32)
        base = np.cumsum(size) - size
        each = size[which] if len(which) else np.empty(0, np.int64)
        place = np.cumsum(each) - each
        body = table[np.repeat(base[which] - place, each) + np.arange(int(each.sum()))] if len(which) else table
        count = np.zeros(n, np.int64)
        word_text = np.searchsorted(text_start[1:], start, "right")
        count[filled] = np.bincount(word_text, each, len(filled)).astype(np.int64) if len(filled) else 0
        offs = np.zeros(n + 1, np.int64)
        np.cumsum(count + 2, out=offs[1:])
        ids = np.empty(int(offs[-1]), np.uint32)
        inner = np.ones(len(ids), bool)
        inner[offs[:-1]] = inner[offs[1:] - 1] = False
        ids[offs[:-1]] = self.bos
        ids[offs[1:] - 1] = self.eos
        ids[inner] = body
        return ids, offs

    # -- decoding

    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each id stands for, and where they begin (one entry more)."""
        if not hasattr(self, "_surface"):
            found = []
            for p, k in zip(self.pieces, self.kinds, strict=True):
                found.append(b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode())
            offs = np.zeros(len(found) + 1, np.int64)
            np.cumsum([len(x) for x in found], out=offs[1:])
            self._surface = np.frombuffer(b"".join(found), np.uint8), offs
        return self._surface

    def decode_slice(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts that ids stand for; bytes that form no character become U+FFFD each."""
        data, where = self.surfaces()
        size = (where[1:] - where[:-1])[ids]
        place = np.cumsum(size) - size
        out = data[np.repeat(where[:-1][ids] - place, size) + np.arange(int(size.sum()))].tobytes()
        ends = np.append(place, len(out))[offs]
        texts = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            raw = out[a + 1 : b] if out[a:b].startswith(b" ") else out[a:b]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = _repair(raw)
            texts.append(raw)
        return texts


def _repair(raw: bytes) -> bytes:
    """Each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            if not n:
                raise ValueError
            raw[at : at + n].decode()
            out.append(raw[at : at + n])
            at += n
        except ValueError:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


_models: dict[bytes, Model] = {}


def model_of(raw: bytes) -> Model:
    """The model, built once in each task."""
    key = hashlib.sha1(raw).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


def forget() -> None:
    """Models and their caches go with the task: an idle worker would hold them beside the next stages."""
    _models.clear()
    gc.collect()


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """Ids of every text: (id_col, ids array<int>) and, with round_trip, the decoded text."""
    schema = "ids array<int>" + ", decoded string" * round_trip

    def make(t: T.Texts) -> dict:
        m = model_of(model)
        ids, offs = m.encode_slice(t)
        out = {"ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))}
        if round_trip:
            out["decoded"] = pa.array([x.decode() for x in m.decode_slice(ids, offs)], pa.string())
        return out

    return T.per_row(df, [text_col], schema, make, [id_col], SLICE, forget)


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids: (id_col, decoded); null and empty arrays give an empty text."""
    kept = df.select(df[id_col], df[ids_col].alias("__ids"))

    def run(batches):
        m = model_of(model)
        for batch in batches:
            column = batch.column(1).cast(pa.large_list(pa.int64()))
            ids = [x or [] for x in column.to_pylist()]
            offs = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) for x in ids], out=offs[1:])
            flat = np.array([y for x in ids for y in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in m.decode_slice(flat, offs)], pa.string())], names=[id_col, "decoded"])

    return kept.mapInArrow(T.tidy(run, forget), f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, decoded string")


def digests(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_tokens, ids_sha256 and decoded_sha256 of what encode() and decode() give."""

    def make(t: T.Texts) -> dict:
        m = model_of(model)
        ids, offs = m.encode_slice(t)
        ids = ids.astype("<u4", copy=False)
        cut = list(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
        return {
            "n_tokens": np.diff(offs),
            "ids_sha256": [hashlib.sha256(ids[a:b]).hexdigest() for a, b in cut],
            "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in m.decode_slice(ids, offs)], pa.string()),
        }

    return T.per_row(df, [text_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, [id_col], SLICE, forget)
