"""Token ids of whole texts, equal to the tokenizer's own, with a bounded cache of their parts.

The tokenizer treats what stands between white space on its own, and within a
word it treats runs of letters, single digits and runs of other characters on
their own. So the ids of a text of the first 256 characters are those of its
parts in turn: a block of texts is cut into parts by array steps, and only parts
that the cache lacks go to the tokenizer's model. Words with other characters
are looked up whole. Texts for which that is not sure (control characters that
only one side takes as space, markers of special tokens), and all texts of a
tokenizer with other rules, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Entries in each of the two generations of a cache.
CACHED = 250_000
#: Characters of text whose parts are held at once; a longer text is cut at white space.
BLOCK = 1 << 20
_loaded: dict[str, WordIds] = {}
_odd = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_wide = re.compile("[^\x00-\xff]").search
_space = re.compile(r"\s")
#: The rules that the parts follow, as a tokenizer's file gives them.
RULES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Stands for a word that is looked up whole; no text cut into parts holds it.
HOLE = "\x1c"
SPACE, OTHER, LETTER, DIGIT = range(4)
LOWER = bytes(ord(chr(i).lower()) for i in range(256))
KINDS = np.array([DIGIT if c == HOLE else SPACE if c.isspace() else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER) for c in map(chr, range(256))], np.uint8)


def parts_of(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Start of each part of lower-cased Latin-1 text, and the parts."""
    kind = KINDS[data]
    solid = kind != SPACE
    start = solid.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(start & (data == ord("'")))  # the tokenizer takes 's, 't, 're, 've, 'm, 'll and 'd as parts
    after = np.concatenate([data, np.zeros(3, np.uint8)])
    pair = after[at + 1].astype(np.int64) << 8 | after[at + 2]
    size = np.isin(after[at + 1], list(b"stmd")) + 2 * np.isin(pair, [x[0] << 8 | x[1] for x in (b"re", b"ve", b"ll")])
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    ends = (at + 1 + size)[at + 1 + size < len(data)]
    start[ends] = solid[ends]
    first = np.flatnonzero(start)
    body = data[solid]
    offsets = np.append(np.flatnonzero(start[solid]), len(body)).astype(np.int32)
    return first, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def pieces_of(text: str) -> Iterator[str]:
    """The text in turn, cut at white space after every `BLOCK` characters."""
    at = 0
    while len(text) - at > BLOCK and (found := _space.search(text, at + BLOCK)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Cache(dict):
    """Two generations: when the younger is full it becomes the older, and what is used again moves back."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def look_up(self, keys: list, learn: Callable[[list], list[bytes]]) -> list[bytes]:
        """The value of each of these distinct keys; `learn` gives those of keys that neither generation holds."""
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()
        out = list(map(self.get, keys))
        lost = [i for i, x in enumerate(out) if x is None]
        older = list(map(self.older.get, [keys[i] for i in lost]))
        new = [i for i, x in zip(lost, older) if x is None]
        learnt = iter(learn([keys[i] for i in new]))
        for i, x in zip(lost, older):
            out[i] = self[keys[i]] = next(learnt) if x is None else x
        return out


class WordIds:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        most = max(vocabulary.values(), default=0)
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.words, self.parts = Cache(), Cache()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        suffix = rules["model"].get("end_of_word_suffix")
        self.parted = bool(suffix) and {k: rules.get(k) for k in RULES} == RULES and all("<|" in x["content"] for x in rules["added_tokens"])
        if self.parted:
            # Parts are normalized and split already: the same model without those steps.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(most + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _many_parts(self, parts: list[str], at_once: int = 200) -> list[bytes]:
        """Each part's ids, from one call for many parts, told apart by tokens that end one."""
        out, size = [], self.kind.itemsize
        for i in range(0, len(parts), at_once):
            some = parts[i : i + at_once]
            ids = np.array(self.model.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * size).tolist()
            if len(ends) != len(some):  # the vocabulary lacks some character
                out += [self._whole(x) for x in some]
                continue
            packed = ids.tobytes()
            out += [packed[a:z] for a, z in zip([0, *ends], ends)]
        return out

    def _many(self, words: list[str], at_once: int = 200) -> list[bytes]:
        """Each word's ids, from one call for many words, told apart by the tokens' places."""
        out = []
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ids, size = np.array(found.ids, self.kind).tobytes(), self.kind.itemsize
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            cuts = [0, *(np.searchsorted(places, np.cumsum([len(w) + 1 for w in some])) * size).tolist()]
            out += [ids[a:z] for a, z in zip(cuts, cuts[1:])]
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, from one pass over the parts of all."""
        plain: list[bytes] = []
        wide: dict[str, int] = {}
        holes: list[int] = []
        for text in texts:
            try:
                plain.append(text.encode("latin-1"))
            except UnicodeEncodeError:
                words = text.split()
                for i, w in enumerate(words):
                    if _wide(w):
                        holes.append(wide.setdefault(w, len(wide)))
                        words[i] = HOLE
                plain.append(" ".join(words).encode("latin-1"))
        data = np.frombuffer(b"\n".join(plain).translate(LOWER), np.uint8)
        first, parts = parts_of(data)
        if not len(parts):
            return [b""] * len(texts)
        coded = parts.dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.parts.look_up(keys, lambda new: self._many_parts([k.decode("latin-1") for k in new]))
        if wide:
            codes = codes.copy()
            codes[codes == keys.index(HOLE.encode())] = np.array(holes, codes.dtype) + len(ids)
            ids += self.words.look_up(list(wide), self._many)
        packed = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        _, places, values = packed.buffers()
        lengths = np.array([len(t) for t in plain], np.int64) + 1
        cuts = np.append(np.searchsorted(first, np.cumsum(lengths) - lengths), len(first))
        cuts = np.frombuffer(places, np.int64)[cuts].tolist()
        view = memoryview(values)
        return [bytes(view[a:z]) for a, z in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian integers of `kind`."""
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        block: list[str] = []
        held = 0

        def pass_on() -> None:
            for row, ids in zip(rows, self._block(block)):
                out[row].append(ids)
            rows.clear()
            block.clear()

        for row, text in enumerate(texts):
            if not self.parted or any(x in text for x in _odd):
                out[row].append(self._whole(text))
                continue
            for piece in pieces_of(text):
                rows.append(row)
                block.append(piece)
                held += len(piece)
                if held >= BLOCK:
                    pass_on()
                    held = 0
        if block:
            pass_on()
        return [b"".join(x) for x in out]


def word_ids(path: str) -> WordIds:
    """The tokenizer at `path`, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
