"""Token ids of texts, as little-endian unsigned 32-bit integers, by a tokenizer file."""

from __future__ import annotations

import json
import os
from array import array

_RUN = 1 << 21
_LOADED: dict[str, Encoder] = {}
#: A blank before white space or the end, where a text can't simply be split at blanks (RE2; white space as fixed values).
_ODD_SPACE = r" (?:[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: The split that byte-level BPE makes before its merges (fixed values).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: itself if printable, else one from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> bytes of its ids, filled as pieces come; long pieces aren't kept."""

    def __init__(self, encode, older: dict | None = None):
        super().__init__()
        self._encode, self.older = encode, older or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def all(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of pieces; as [self[p] for p in pieces], but with fewer calls."""
        encode, older, out = self._encode, self.older.get, list(map(self.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                ids = older(piece)
                if ids is None:
                    ids = encode(piece)
                out[i] = ids
                if len(piece) <= 64:
                    self[piece] = ids
        return out

    def renewed(self, most: int) -> _Pieces:
        """This table, or past most pieces an empty one that still looks into this one."""
        if len(self) <= most:
            return self
        self.older = {}
        return _Pieces(self._encode, self)


class Encoder:
    """Encodes whole texts.

    Byte-level BPE splits a text before each blank that a non-blank follows, whatever stands around, so the pieces
    between such places are encoded apart, each once a batch, and their ids remembered: the last most_pieces to twice
    as many, of pieces and of their parts. A tokenizer of another kind encodes each text in one go.
    """

    def __init__(self, path: str, most_pieces: int = 350_000):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split = config.get("pre_tokenizer") or {}
        self._piecewise = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not config.get("normalizer")
        if array("I").itemsize != 4:
            raise RuntimeError("unsigned int has not 4 bytes here")

        def whole(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        tokenize, letters, find = tokenizer.model.tokenize, _byte_letters(), regex.compile(_SPLIT).findall
        blank = letters[32]

        def part(text: str) -> bytes:
            plain = text.isascii() and text.isprintable()
            return array("I", [t.id for t in tokenize(text.replace(" ", blank) if plain else text.encode().decode("latin-1").translate(letters))]).tobytes()

        def parts(text: str) -> bytes:
            return b"".join(map(self._parts.__getitem__, find(text)))

        def piece(text: str) -> bytes:
            """The ids of a piece; one of Latin letters or ASCII digits only, after a blank or not, is a part of its own."""
            bare = text[1:] if text[:1] == " " else text
            if bare.isascii():
                if bare.isalpha() or bare.isdigit():
                    return array("I", [t.id for t in tokenize(text.replace(" ", blank))]).tobytes()
            elif bare.isalpha() and max(bare) < "\u0250":
                return part(text)
            found = find(text)
            return part(text) if len(found) == 1 else b"".join(map(self._parts.__getitem__, found))

        self.vocabulary = tokenizer.get_vocab_size()
        self._most, self._whole, self._text = most_pieces, whole, parts
        self._parts = _Pieces(piece)

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return self._text(text) if self._piecewise else self._whole(text)

    def encode_batch(self, texts, end_id: int):
        """Yield, for runs of texts of about _RUN bytes (a longer text is a run of its own), (ids of all texts end to end, each text's ids followed by end_id; where each text begins, and the end), of an Arrow array of strings; null counts as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        runs = np.cumsum(np.asarray(pc.binary_length(texts))) // _RUN
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield self._encode_run(texts[a:b], end_id)
                self._parts = self._parts.renewed(self._most)

    def _encode_run(self, texts, end_id: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, _ODD_SPACE) if self._piecewise else pa.array([True] * len(texts), pa.bool_())
        pieces = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        begins = np.asarray(pieces.offsets)
        coded = pieces.values.dictionary_encode()
        which, known = np.asarray(coded.indices).astype(np.int64), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        heads = begins[:-1] - begins[0]
        first, odd = coded.dictionary.take(pa.array(which[heads])).to_pylist(), odd.to_pylist()
        used = np.bincount(which, minlength=len(known))
        np.subtract.at(used, which[heads], 1)  # a first piece has no blank before it
        for i in np.flatnonzero(used == 0).tolist():
            known[i] = ""
        ids = self._parts.all(known)
        ids += [self.encode(texts[i].as_py()) if o else self._parts_of(f) for i, (o, f) in enumerate(zip(odd, first, strict=True))]
        which[heads] = np.arange(len(heads)) + len(known)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        flat = table[np.repeat(starts[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        closes = ends[np.append(heads[1:], len(which)).astype(np.int64) - 1] if len(heads) else np.zeros(0, np.int64)
        flat = np.insert(flat, closes, np.uint32(end_id))
        return flat, np.concatenate([[0], closes + np.arange(1, len(closes) + 1)]).astype(np.int64)

    def _parts_of(self, text: str) -> bytes:
        return self._text(text) if text else b""


def encoder(path: str) -> Encoder:
    """The encoder of path, once a process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
