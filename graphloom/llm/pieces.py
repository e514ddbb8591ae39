"""Exact encoding and decoding for merge-type (BPE) sentencepiece models.

A text is encoded by backtracking, not by merging: at each position the longest matching piece
(found by an Aho-Corasick automaton) is tried first, and is kept if it may stand beside the piece
before it; else shorter prefixes follow. Two pieces may stand side by side if merging their joined
characters again gives these two pieces. A position from which no piece leads on is marked in a
bitfield, and the piece before it is given up. An encoding all of whose neighbours are compatible is
the one that merging gives, and there is only one.

Pieces hold a space mark only in front (checked when a model is read), so a text falls apart into
words that are encoded on their own; a bounded memory of words makes repeated words cheap.

Null and empty texts give the begin and end ids only. Texts of any length are encoded whole. Rows are
independent: equal rows give equal results, an empty table gives an empty result, and columns not
named in the call are neither read nor touched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: Name of a public vocabulary file; any other is given by its path.
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words and pairs of pieces that a worker remembers at most.
WORDS, PAIRS, LONGEST_WORD = 1_000_000, 1 << 20, 48


class PieceModel:
    """A model file's bytes, read; cheap to make anew in every task."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models without user-defined or unused pieces are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are read")
        self.dummy_prefix = norm.add_dummy_prefix
        self.unknown_surface = trainer.unk_surface.encode()
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.chars = {p for p in self.ids if len(p) == 1}
        self.word_marks = all(SPACE not in p.lstrip(SPACE) for p in self.ids)


class Encoder:
    def __init__(self, model: PieceModel):
        import ahocorasick

        self.m = model
        self.sizes = [len(p) for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        trie = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            # a piece that merging its own characters can't reach never occurs
            if len(piece) == 1 or self.merged(piece) == [i]:
                trie.add_word(piece, (i, len(piece)))
        trie.make_automaton()
        self.trie = trie
        self.shorter: dict[int, int] = {}
        for piece, i in model.ids.items():
            for n in range(len(piece) - 1, 0, -1):
                if (j := model.ids.get(piece[:n])) is not None and piece[:n] in trie:
                    self.shorter[i] = j
                    break
        breaks = "" if "\n" in model.chars else "\n"
        self.plain_words = model.word_marks and model.dummy_prefix and bool(breaks)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}+" if breaks else "")).findall if model.word_marks else None

    def merged(self, text: str) -> list[int]:
        """What merging gives for a short text of known characters: best score first, then leftmost."""
        ids, scores, parts = self.m.ids, self.m.scores, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                if (j := ids.get(parts[k] + parts[k + 1])) is not None and (best is None or scores[j] > best):
                    best, at = scores[j], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.m.pieces[left] + self.m.pieces[right]) == [left, right]
        return known

    def known_run(self, run: str) -> list[int]:
        """Backtracking over a run of characters that are all pieces."""
        pairs = self.pairs
        out, before = [], -1
        for _, (i, _) in self.trie.iter_long(run):  # the longest match each time: what backtracking gives if it never has to step back
            if before >= 0 and not (pairs[key] if (key := before << 32 | i) in pairs else self.compatible(before, i)):
                break
            out.append(i)
            before = i
        else:
            return out
        return self.backtracked(run)

    def backtracked(self, run: str) -> list[int]:
        n = len(run)
        longest = [0] * n
        for last, (i, size) in self.trie.iter(run):
            longest[last - size + 1] = i
        sizes, pairs, shorter = self.sizes, self.pairs, self.shorter
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece, before = 0, longest[0], -1
        while True:
            stop = at + sizes[piece]
            fits = not failed[stop >> 3] >> (stop & 7) & 1
            if fits and before >= 0 and (fits := pairs.get(before << 32 | piece)) is None:
                fits = self.compatible(before, piece)
            if fits:
                out.append(piece)
                if stop == n:
                    return out
                before, at, piece = piece, stop, longest[stop]
            elif piece in shorter:
                piece = shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                before = out[-1] if out else -1
                at -= sizes[piece]

    def word(self, word: str) -> bytes:
        """Ids of a word, as little-endian unsigned 32-bit integers."""
        chars = self.m.chars
        if chars.issuperset(word):
            return self.packed(self.known_run(word))
        out, k, n = [], 0, len(word)
        while k < n:
            j = k
            while j < n and word[j] in chars:
                j += 1
            if j > k:
                out += self.known_run(word[k:j])
            if j < n:
                out += [self.m.byte_ids[b] for b in word[j].encode("utf-8", "replace")] if self.m.byte_ids else [self.m.unknown]
            k = j + 1
        return self.packed(out)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def new_word(self, w: str) -> bytes:
        """Ids of a word that the newer memory lacks; it takes half of what is remembered, the older one the rest.

        w stands for itself with a space mark in front; after a mark, or with a line end in front, for itself.
        """
        ids = self.words_before.get(w)
        if ids is None:
            ids = self.word(w[1:] if w[0] == SPACE else w if w[0] == "\n" else SPACE + w)
        if len(w) <= LONGEST_WORD:
            if len(self.words) >= WORDS // 2:
                self.words_before = self.words.copy()
                self.words.clear()
            self.words[w] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.words
        if self.plain_words and text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text and SPACE not in text:
            # a space before each word; a word that begins a line has a line end there instead
            return b"".join([known.get(w) or self.new_word(w) for w in text.replace("\n", " \n").split(" ")])
        text = (SPACE if self.m.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.split:
            return self.word(text)
        keys = [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE) else SPACE + w for w in self.split(text)]
        return b"".join([known.get(w) or self.new_word(w) for w in keys])


_READY: dict[bytes, tuple[Encoder, Decoder]] = {}


def ready(raw: bytes) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a model; a worker process keeps those of the last model for its next tasks."""
    key = hashlib.sha256(raw).digest()
    if key not in _READY:
        _READY.clear()
        model = PieceModel(raw)
        _READY[key] = Encoder(model), Decoder(model)
    return _READY[key]


class Decoder:
    def __init__(self, model: PieceModel):
        self.m = model
        self.plain = [self._bytes(i) for i in range(len(model.pieces))]
        self.is_byte = [k == BYTE for k in model.kinds]

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.m.kinds[i], self.m.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.m.unknown_surface
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.encode()

    def decode(self, ids) -> str:
        """Text of ids; control pieces vanish, byte pieces join to characters, bad bytes become U+FFFD."""
        plain, mark = self.plain, SPACE.encode()
        raw = b"".join([plain[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        first = next((i for i in ids if self.m.kinds[i] != CONTROL), None)
        if first is not None and self.m.dummy_prefix and self.plain[first].startswith(mark) and self.m.kinds[first] == NORMAL:
            text = text[1:]
        return text.replace(SPACE, " ")

    def _decode_slowly(self, ids) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.plain[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        n = 0
                if not n:
                    out.append("�")
                del run[: n or 1]
            if i is not None:
                out.append(self.plain[i].decode())
        return "".join(out)


def read_model(path: str | None = None) -> bytes:
    """Read by the driver alone; tasks get the bytes (a vocabulary file, under a few MB)."""
    with open(path or C.tokenizer_file(MODEL), "rb") as f:
        return f.read()


def encoded(docs: DataFrame, carry: list[str], model: str | None = None, text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Every row's `carry` columns with n_tokens, ids_sha256 and decoded_sha256.

    ids and decoded add the ids themselves (array of long) and the decoded text.
    """
    import numpy as np

    raw = docs.sparkSession.sparkContext.broadcast(read_model(model))
    out = C.struct(n_tokens=C.LONG, ids_sha256=C.STRING, decoded_sha256=C.STRING)
    out = T.StructType([*out, *([T.StructField("ids", T.ArrayType(C.LONG))] if ids else []), *([T.StructField("decoded", C.STRING)] if decoded else [])])

    def make() -> Callable[[list[str]], dict[str, list]]:
        encoder, decoder = ready(raw.value)
        m = encoder.m
        begin, end = m.begin.to_bytes(4, "little"), m.end.to_bytes(4, "little")

        def work(texts: list[str]) -> dict[str, list]:
            made: dict[str, list] = {f.name: [] for f in out}
            for t in texts:
                coded = begin + encoder.encode(t) + end
                numbers = np.frombuffer(coded, "<u4").tolist()
                back = decoder.decode(numbers)
                made["n_tokens"].append(len(numbers))
                made["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    made["ids"].append(numbers)
                if decoded:
                    made["decoded"].append(back)
            return made

        return work

    return C.map_texts(docs, carry, text, make, out)
