"""Token ids of whole texts by a public tokenizer, each distinct piece encoded once.

A text is cut where its tokenizer cuts anyway (at the strings of special tokens and
before a space), the pieces are dictionary-encoded column-wise, pieces of common letters and signs are
cut into pre-tokens by their bytes' classes at once, others by a regular expression each, and
only pre-tokens not seen before reach the library's BPE model.  The ids equal those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import ctypes
import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct pre-tokens that a worker remembers before it starts afresh, and their bytes.
REMEMBERED = 200_000
REMEMBERED_BYTES = 8 << 20
#: Text that is worked on at once.
CHUNK_BYTES = 2 << 20

#: White space of Unicode, for a matcher whose own class is of ASCII only.
_BLANK = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = r"\p{White_Space}"
#: The cuts of the two kinds of public BPE vocabulary, by whether white space is kept.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_CUTS = {
    True: regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"),
    False: regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"),
}
#: Stands between pre-tokens that are mapped together: half a surrogate pair, which no text holds; as a byte 0xFF.
_BETWEEN = "\udcff"
#: Pieces whose pre-tokens are runs of one class: printable ASCII without the apostrophe of contractions,
#: letters from U+00C0 to U+00FF, and single line ends between them.
_VISIBLE = "[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PLAIN = rf"\A{_VISIBLE}(?:\n{_VISIBLE})*\z"
_LETTER, _DIGIT, _OTHER, _BREAK = 0, 1, 2, 3
#: Of each byte; those from 128 on are of letters here.
_CLASSES = np.array([_BREAK if b == 10 else _LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER for b in range(256)], np.uint8)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _joined(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begins[i] : begins[i] + sizes[i]] one after another, and their bounds."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])], upto


def _folded(text: str) -> str:
    """The text in normal form C, lower-cased letter by letter; at once where that is the same."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # an eighth of the time of to_pylist


def _bounds(lists: pa.Array) -> np.ndarray:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0]


class PieceEncoder:
    """Encodes arrays of texts.  ``keeps_space``: the vocabulary has white space in its tokens."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers.models import BPE

        self.path = path
        self.remembered = REMEMBERED if remembered is None else remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"no rule for the model of {path}")
        options = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)  # what it has seen is remembered here
        kinds = json.dumps(spec["pre_tokenizer"])
        self.keeps_space = '"use_regex": true' in kinds and spec["normalizer"] is None
        lowers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if not self.keeps_space and not (lowers and '"invert": true' in kinds):
            raise ValueError(f"no rule for cutting the texts of {path}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"no rule for the special tokens of {path}")
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.chars = _byte_chars() | {0xFF: "\n"}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {} if self.keeps_space else {"\n": 0}  # without ids then
        self.held = 0  # bytes of the pre-tokens in place
        self.flat = np.empty(0, np.uint32)
        self.ends = np.zeros(len(self.place) + 1, np.int64)  # ends[i + 1]: where the ids of pre-token i end in flat

    @property
    def tokenizer(self):
        """The library's own tokenizer of this vocabulary."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where the pre-tokens are remembered; new ones are encoded first."""
        place = self.place
        at = [place.get(p) for p in parts]
        if None in at:
            new = list(dict.fromkeys(p for p, n in zip(parts, at, strict=True) if n is None))
            mapped = _BETWEEN.join(new).encode("utf-8", "surrogateescape").decode("latin-1").translate(self.chars).split("\n")
            tokenize = self.model.tokenize
            ids = [[t.id for t in tokenize(m)] for m in mapped]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.held += sum(map(len, new))
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            at = [place[p] if n is None else n for p, n in zip(parts, at, strict=True)]
        return np.array(at, np.int64)

    def _plain(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pre-tokens of plain pieces, one after another, and how many a piece has."""
        if self.keeps_space:
            pieces = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces, pa.scalar(" ", pa.large_string()))
        else:
            pieces = pc.utf8_lower(pieces)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        data, first = data[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0]
        kind = _CLASSES[data]
        cut = np.append(True, kind[1:] != kind[:-1])
        if not self.keeps_space:
            cut |= kind == _DIGIT  # digits stand alone
        cut[first] = True
        if self.keeps_space:
            cut[first + 1] = False  # the space goes with what follows
        begins = np.flatnonzero(cut)
        ends = pa.py_buffer(np.append(begins, len(data)))
        coded = pa.Array.from_buffers(pa.large_string(), len(begins), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        return self._places(_strings(coded.dictionary))[coded.indices.to_numpy()], np.diff(np.searchsorted(begins, np.append(first, len(data))))

    def _pieces(self, pieces: pa.Array, more: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of pieces between spaces and of ``more`` texts, in any order; where each one's begin and end."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        simple = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        odd = _strings(pieces.filter(pc.invert(plain)))
        texts = [*(f" {t}" for t in odd), *more] if self.keeps_space else [_folded(t) for t in [*odd, *more]]
        cuts = [_CUTS[self.keeps_space].findall(t) for t in texts]
        at, sizes = self._plain(pieces.filter(plain)) if len(simple) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.concatenate([at, self._places([p for c in cuts for p in c])])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.array([len(c) for c in cuts], np.int64)]))])
        ids, until = _joined(self.flat, self.ends[at], self.ends[at + 1] - self.ends[at])
        bounds = until[upto]
        place = np.empty(len(pieces) + len(more), np.int64)  # of each piece in the order of bounds
        place[simple] = np.arange(len(simple))
        place[np.setdiff1d(np.arange(len(place)), simple, assume_unique=True)] = np.arange(len(simple), len(place))
        return ids, bounds[place], bounds[place + 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another (uint32), and where each text begins and ends (one more than texts)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(texts)
        # what stands between special tokens is encoded by itself
        parts = [self.at_special.split(t.as_py()) if o else [t.as_py()] for t, o in zip(texts, odd.tolist(), strict=True)]
        ids, bounds = self._encode(pa.array([x for p in parts for x in p[::2]], pa.large_string()))
        last = np.cumsum([len(p) // 2 + 1 for p in parts])  # plain parts up to each text's end
        after = np.setdiff1d(np.arange(last[-1]), last - 1)  # plain parts that a special token follows
        ids = np.insert(ids, bounds[after + 1], np.array([self.special[x] for p in parts for x in p[1::2]], np.uint32))
        return ids, np.concatenate([[0], bounds[last] + np.cumsum([len(p) // 2 for p in parts])])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without special tokens."""
        if len(self.place) > self.remembered or self.held > REMEMBERED_BYTES:
            self._forget()
        if self.keeps_space:
            # a space after white space is no cut: such texts stay whole
            odd = pc.match_substring_regex(texts, rf"[{_BLANK}] ")
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            lists = pc.split_pattern(pc.if_else(odd, "", texts) if len(whole) else texts, " ")
        else:
            whole, lists = [], pc.split_pattern(texts, " ")
        bounds = _bounds(lists)
        coded = lists.flatten().dictionary_encode()
        pieces, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        first: list[str] = []
        if self.keeps_space:
            first = [t.partition(" ")[0] for t in texts.to_pylist()]
            for i in whole:
                first[i] = texts[int(i)].as_py()
            at[bounds[:-1]] = len(pieces) + np.arange(len(first))
        flat, begins, ends = self._pieces(pieces, first)
        ids, upto = _joined(flat, begins[at], ends[at] - begins[at])
        return ids, upto[bounds]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, remembered: int | None = None) -> PieceEncoder:
    """One encoder per worker process and vocabulary, as workers outlive tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].remembered = REMEMBERED if remembered is None else remembered
    return _ENCODERS[path]


def _release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES, vocabulary: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, so that memory does not follow the batch.

    Encoders that earlier tasks left in this worker go, but for that of ``vocabulary``.
    """
    for path in _ENCODERS.keys() - {vocabulary}:
        del _ENCODERS[path]
    _release()  # workers outlive tasks, and keep what earlier ones have freed
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    _release()


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text", most: int = CHUNK_BYTES, remembered: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their ids and bounds.  Larger slices and more pieces to remember save time and cost memory."""
    own = encoder(path, remembered)
    for batch in chunks(batches, text, most, path):
        yield batch, *own.encode(batch.column(text))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
